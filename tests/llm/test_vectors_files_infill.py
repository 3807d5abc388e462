"""Whitening, id files and fill-in-middle, against plain Python on small hard cases."""

import hashlib
import math
import os
import re
import sys
import zlib
from collections import Counter
from decimal import Decimal

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from stepwell.llm import idfiles, infill, queries, whitening  # noqa: E402

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


# --- 11 ----------------------------------------------------------------------------------


def whitened_plain(vectors, components=32):
    """{id: (deviation, |whitened|)} and the fit, in whole numbers and plain numpy."""
    x = {i: [math.floor(64 * float(c)) + 1_000_000 for c in v] for i, v in vectors}
    n, rows = len(x), list(x.values())
    sums = [sum(c) for c in zip(*rows)]
    centred = np.array([[n * c - s for c, s in zip(r, sums)] for r in rows], float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    w = centred @ axes[:, order] / np.sqrt(values[order])
    deviations = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in rows]
    return {i: (d, np.abs(v)) for i, d, v in zip(x, deviations, w)}, values[order] / values.sum()


def test_bit_planes_multiply_exactly():
    rng = np.random.default_rng(3)
    bits = np.array([3, 0, 7, 40, 1])
    y = np.stack([rng.integers(0, 1 << int(b), 130) if b else np.zeros(130, int) for b in bits], axis=1).astype(np.uint64)
    limbs = np.zeros((3, 5, 5), np.int64)
    whitening.add_products(limbs, *whitening.bit_planes(y, bits))
    for i in range(5):
        for j in range(i, 5):
            got = sum(int(limbs[k, i, j]) << (whitening.LIMB * k) for k in range(3))
            assert got == sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j]))


VECTOR_SCHEMA = "vec_id long, embedding array<float>, label int, whitened string, deviation int, n long"


@pytest.mark.parametrize("block", [1 << 19, 64])
def test_whitening_against_plain(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK_VALUES", block)
    rng = np.random.default_rng(5)
    mixed = rng.normal(size=(6, 6))
    good = [(i, (rng.normal(size=6) @ mixed).astype(np.float32).tolist()) for i in range(300)]
    good += [(300 + i, good[0][1]) for i in range(40)] + [(7, good[7][1])]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("-inf")] * 6), (904, []), (905, [1.0] * 5), (906, [1e30] * 6)]
    rows = [(i, v, None, "w", 1, 2) for i, v in good + bad]
    vectors = spark.createDataFrame(rows, VECTOR_SCHEMA).repartition(5)
    model = whitening.fit(vectors, components=4)
    plain, explained = whitened_plain(list(enumerate(v for _, v in good)), 4)
    assert model.n == len(good) and np.allclose(model.explained, explained, rtol=1e-9)
    found = whitening.whiten(vectors, model)
    assert found.columns == ["vec_id", "embedding", "label", "n", "whitened", "deviation"]
    want = Counter((i, plain[k][0]) for k, (i, _) in enumerate(good))
    got = found.collect()
    assert Counter((r["vec_id"], int(r["deviation"])) for r in got) == want
    by_id = {i: plain[k][1] for k, (i, _) in enumerate(good)}
    assert all(np.allclose(np.abs(r["whitened"]), by_id[r["vec_id"]], atol=1e-8) for r in got)
    assert whitening.identity_error(vectors, model) < 1e-9


def test_whitening_of_hard_rows(spark):
    nothing = spark.createDataFrame([], VECTOR_SCHEMA)
    for empty in (nothing, spark.createDataFrame([(1, None, 1, "", 1, 1), (2, [], 1, "", 1, 1)], VECTOR_SCHEMA)):
        model = whitening.fit(empty)
        assert whitening.identity_error(empty, model) is None and whitening.whiten(empty, model).count() == 0
    # no variance at all, and in some directions
    same = spark.createDataFrame([(i, [0.5, 0.25], 1, "", 1, 1) for i in range(5)], VECTOR_SCHEMA)
    model = whitening.fit(same)
    assert [(r["whitened"], r["deviation"]) for r in whitening.whiten(same, model).collect()] == [([None, None], Decimal(0))] * 5
    line = spark.createDataFrame([(i, [0.5 * i, 0.5 * i, 1.0], 1, "", 1, 1) for i in range(5)], VECTOR_SCHEMA)
    model = whitening.fit(line)
    got = whitening.whiten(line, model).orderBy("vec_id").collect()
    assert all(r["whitened"][1:] == [None, None] for r in got) and whitening.identity_error(line, model) < 1e-9
    assert np.isclose(abs(got[4]["whitened"][0]), math.sqrt(2)) and np.isclose(model.explained[0], 1)
    # entries that need all 64 bits
    wide = [(i, [float(v) for v in row]) for i, row in enumerate(np.random.default_rng(1).integers(-(2**50), 2**50, (9, 2)))]
    far = spark.createDataFrame(wide, "vec_id long, embedding array<double>")
    model = whitening.fit(far)
    plain, _ = whitened_plain(wide)
    assert {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(far, model).collect()} == {i: d for i, (d, _) in plain.items()}


@needs_tables
def test_whitening_query(spark):
    found = queries.QUERIES["op11_whitening"](spark, SF)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    plain, explained = whitened_plain(vectors)
    rows = found.collect()
    assert len(rows) == 32 * len(vectors)
    for r in rows:
        deviation, w = plain[r["vec_id"]]
        assert r["deviation"] == deviation and r["n"] == len(vectors) and r["identity_error"] <= 1e-4
        assert abs(abs(r["whitened"]) - w[r["component"] - 1]) < 1e-6
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-4


# --- 12 ----------------------------------------------------------------------------------

HARD = [
    (5, "It's  two   blanks, 'll\tand\n\n tabs. "), (3, None), (4, ""), (4, "again"), (4, "again"), (None, "no key"), (-7, " lead"), (9, "日本語 text　wide blank  em"),
    (10, "x" * 3000 + " y" * 3000), (11, "<|endoftext|> in <|endoftext|> text"), (12, "a\x00b \x1c c\x85 d 🎉 e"), (13, "12 345  67 ...  !! ?"), (14, "end "), (15, " "), (16, "\n \n"),
]


def reference(special=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_file())
    t.encode_special_tokens = not special
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("special", [False, True])
def test_chunks_encode_as_whole_texts(special):
    import pyarrow as pa

    from stepwell.llm.textkit import text_blocks

    rng = np.random.default_rng(11)
    alphabet = list("ab Z9.,'\n\t\r   é日🎉") + [" ", " ", "　", "\x85", " ", "\x1c", "'s", "<|endoftext|>", " ", " "]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(3000)]
    whole = reference(special)
    with open(queries.tokenizer_file(), "rb") as file:
        encoder = idfiles.Encoder(file.read(), special)
    for lo, _, data, offsets in text_blocks(pa.array(texts), 5000):
        ids, bounds = encoder.encode(data, offsets)
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            assert ids[a:b].tolist() == whole(texts[lo + i]), repr(texts[lo + i])


@pytest.mark.parametrize("parts", [1, 7])
def test_id_files_in_key_order(spark, folder, parts):
    rows = [(k, t, 1, "s", None) for k, t in HARD] + [(100 + i % 50, f"word {i} " * (i % 9), 1, "s", None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long, ids string, n_tokens long").repartition(parts)
    whole = reference()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        total = idfiles.write_ids(docs, folder, queries.tokenizer_file())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = sorted(idfiles.read_ids(spark, folder).collect(), key=lambda r: r["start"])
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in found) == Counter((k, (*whole(t), 0)) for k, t, *_ in rows)
    keys = [r["doc_id"] for r in found]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    at = 0
    for r in found:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    assert at == total
    # the shards one after another are the whole: flat numbers, nothing else, no files of attempts
    names = sorted(os.listdir(folder))
    assert all(re.fullmatch(r"\d{8}\.(ids|idx)", n) for n in names) and len(names) > 2
    flat = np.concatenate([np.fromfile(f"{folder}/{n}", "<u2") for n in names if n.endswith(".ids")])
    assert flat.tolist() == [i for r in found for i in r["ids"]]
    packed = idfiles.read_ids(spark, folder, packed=True)
    assert {(r["start"], bytes(r["ids"])) for r in packed.collect()} == {(r["start"], np.array(r["ids"], "<u4").tobytes()) for r in found}


def test_id_files_of_nothing(spark, folder):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert idfiles.write_ids(nothing, folder, queries.tokenizer_file()) == 0
    assert idfiles.read_ids(spark, folder).count() == 0 and os.listdir(folder) == []
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert idfiles.write_ids(blank, f"{folder}/none", queries.tokenizer_file(), end_id=None) == 0
    assert sorted((r["doc_id"], r["start"], r["ids"]) for r in idfiles.read_ids(spark, f"{folder}/none").collect()) == [(1, 0, []), (2, 0, [])]
    with pytest.raises(ValueError):
        idfiles.write_ids(blank, "s3://bucket/ids", queries.tokenizer_file())


@needs_tables
def test_id_file_query(spark):
    whole, at = reference(), 0
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.QUERIES["op12_id_files"](spark, SF).collect()}
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = np.array([*whole(text), 0], "<u4")
        assert got[doc_id] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


# --- 13 ----------------------------------------------------------------------------------


def infill_plain(key, text, fim=100, spm=50):
    text = text or ""
    cut = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(cut)
    name = hashlib.sha256(text.encode()).hexdigest() if key is None else str(key)
    h = [int(hashlib.sha256(f"7:{name}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(cut[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= fim:
        return key, n, "plain", None, None, text
    if h[3] % 100 < spm:
        return key, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return key, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("slice_bytes,fim,spm", [(4 << 20, 100, 50), (50, 60, 20), (1, 100, 0)])
def test_infill_against_plain(spark, monkeypatch, slice_bytes, fim, spm):
    monkeypatch.setattr(infill, "SLICE_BYTES", slice_bytes)
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(["a", "<", "S>", "<P", ">", "\n", "\r\n", "é", "🎉 "], rng.integers(0, 60))) for _ in range(300)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, "other\nlines\n"), (None, "a\nb\nc"), (None, None), (900, None), (901, ""), (902, "\n"), (903, "\n\n\n"), (904, "x\n" * 50_000), (905, "y" * 300_000), (906, "has <M> inside\n")]
    rows = [(k, t, "c", 7, "f", 5) for k, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n_units int, form string, `a b` int")
    found = infill.rearrange(docs, fim_percent=fim, spm_percent=spm)
    assert found.columns == ["doc_id", "text", "a b", "n_units", "form", "prefix_chars", "middle_chars", "output"]
    back = found.withColumn("again", infill.restored(found["output"], found["form"])).collect()
    want = Counter(infill_plain(k, t, fim, spm) for k, t, *_ in rows)
    assert Counter((r["doc_id"], r["n_units"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in back) == want
    assert all(r["again"] == (r["text"] or "") for r in back)
    assert infill.rearrange(docs.limit(0)).count() == 0


def test_infill_sql_on_hard_rows(spark):
    rows = [(k, t) for k, t in HARD if t is None or "\x00" not in t] + [(20, "a\nb\r\nc"), (21, "\n\n"), (22, "<S>\nx")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = Counter(con.execute(queries.INFILL_SQL).fetchall())
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = Counter((*infill_plain(k, t)[:5], sha(infill_plain(k, t)[5]), sha(t)) for k, t in rows)
    assert got == want
