"""Operators with exact results, against plain Python on small hard cases."""

import hashlib
import os
import re
import sys
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from stepwell.llm import fingerprints, forest, mixing, passages, quality, queries, repeats, suffix_array, textkit, tokens  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# every added name that could clash, as columns of the input
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, score double, id long, th long"

LONG = " ".join(f"w{i % 700}" for i in range(40_000))
TEXTS = [
    (1, "one two three four five six seven eight nine ten " * 9, "en", "a"),
    (2, "one two three four five six seven eight nine ten " * 9, "en", "a"),
    (2, "one two three four five six seven eight nine ten " * 9, "en", "a"),
    (3, "", "en", "b"),
    (4, None, None, None),
    (5, " \t\n \x0b", "de", "b"),
    (None, "only words without a key, twice", "de", None),
    (None, "only words without a key, twice", "de", None),
    (6, "word", "fr", "c"),
    (7, "WORD", "fr", "c"),
    (8, LONG, "en", "a"),
    (9, "Ärger über Öl 日本語 🎉🎉 x" * 40, "de", "d"),
    (10, LONG[:100_000] + " tail", None, "a"),
    (11, "a b c a b c\na b c", "en", "b"),
    (12, "line one here\nline one here\n\n \nline two\nline one here", "en", "b"),
    (13, "#*$ %&| <> a# b* c$", "es", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*t, len(t[1] or ""), 7, False, 0.5, 1, 2) for t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return WORD.findall(text or "")


def table(df):
    return Counter(tuple(r) for r in df.collect())


# --- words and shingles ------------------------------------------------------------------


def test_word_spans_are_the_pattern():
    import pyarrow as pa

    texts = [t[1] for t in TEXTS] + ["\x1c\x1d a\x85b", "x", " x", "x "]
    got = [[] for _ in texts]
    for lo, _, data, offsets in textkit.text_blocks(pa.array(texts), 1000):
        for s, e, o in zip(*textkit.word_spans(data, offsets)):
            got[lo + o].append(data[s:e].tobytes().decode())
    assert got == [words_of(t) for t in texts]


# --- 1 -----------------------------------------------------------------------------------


def counts(text):
    words = words_of(text)
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    at = {i + j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(at))


def test_quality_counts(docs):
    got = table(quality.rate(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    want = Counter()
    for doc_id, text, *_ in TEXTS:
        c = counts(text)
        want[(doc_id, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert got == want


def test_quality_thresholds_follow_each_group(spark):
    """What a twentieth of a source does stands out; what a third of it does is its norm."""
    good = " ".join(f"word{i}" for i in range(60))
    bad = " ".join(f"word{i}##" for i in range(60))
    rows = [(i, bad if i % 20 == 0 else good, "en", "x", 0, 0, None, None, None, None) for i in range(4000)]
    rows += [(5000 + i, bad if i % 3 == 0 else good, "en", "y", 0, 0, None, None, None, None) for i in range(300)]
    rows += [(9000, good, "de", "z", 0, 0, None, None, None, None), (9001, bad, None, None, 0, 0, None, None, None, None), (9002, "short", "fr", "q", 0, 0, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    rated = quality.rate(docs).join(docs.select("doc_id", "lang", "source"), "doc_id")
    found = rated.collect()
    kept = {(r["source"], r["n_symbols"] > 0, r["kept"]) for r in found if r["source"] in ("x", "y")}
    assert kept == {("x", False, True), ("x", True, False), ("y", False, True), ("y", True, True)}
    limit = {r["source"]: r["hi_symbols"] for r in found}
    # a single document has its language's and all documents' thresholds, blended
    assert limit["x"] <= limit["z"] < limit["y"] and limit["q"] is not None
    assert {r["source"]: r["group_docs"] for r in found} == {"x": 4000, "y": 300, "z": 1, None: 1, "q": 0}
    assert quality.filtered(docs).columns == docs.columns
    assert quality.filtered(docs).count() == sum(r["kept"] for r in found)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the generated tables")
def test_quality_thresholds_differ_between_sources(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    measured = textkit.stored(quality.measure(docs.select("lang", "source", "text")).drop("text"))
    limits = quality.thresholds(quality.sketches(measured), measured.select("lang", "source").distinct()).collect()
    for s in quality.SHARES:
        assert len({r[f"hi_{s}"] for r in limits}) > 5, s


def test_quality_sketches_merge(docs):
    measured = quality.measure(docs.select("lang", "source", "text"))
    whole = table(quality.sketches(measured))
    parts = quality.sketches(measured.filter("n_words % 2 = 0")).union(quality.sketches(measured.filter("n_words % 2 = 1")))
    assert table(parts.groupBy("lang", "source", "share", "bucket").sum("n")) == whole


# --- 2 -----------------------------------------------------------------------------------


def shared_targets(sizes, weights=(5, 2, 1), cap=3.0):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix_meets_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 50)), None, [None, "a", "b", "c", "é", "z"][min(i % 11, 5)], 0, 0, None, None, None, None) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mixing.mix(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    target, taken = shared_targets(sizes), Counter()
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 25
    assert sum(r["copies"] for r in found) == mixing.mixed(docs).count()
    assert mixing.mixed(docs).columns == docs.columns


def test_mix_budgets_are_nested(docs):
    runs = [mixing.mix(docs, budgets=b).select("doc_id", "text", "copies").collect() for b in ((0.2,), (0.5,), (1.0,))]
    sums = [{(r["doc_id"], r["text"]): r["copies"] for r in run} for run in runs]
    assert all(sums[0][k] <= sums[1][k] <= sums[2][k] for k in sums[0])
    both = mixing.mix(docs, budgets=(0.2, 1.0)).collect()
    assert {(r["doc_id"], r["text"]): r["copies"] for r in both} == sums[2]
    assert all((r["first_budget"] == 0.2) == (sums[0][r["doc_id"], r["text"]] > 0) for r in both)


def test_mix_of_hard_rows(docs, nothing):
    found = mixing.mix(docs)
    assert found.count() == len(TEXTS)
    assert {r["doc_id"] for r in found.filter("size = 0").collect()} == {3, 4, 5}
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


# --- 3 -----------------------------------------------------------------------------------


def test_edits_use_the_next_document(spark):
    import random

    rng = random.Random(4)
    rows = [(i * i, "".join(rng.choice("abcdé 🎉") for _ in range(rng.choice([0, 1, 3, 50, 400])))) for i in range(120)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ordered = sorted(rows)
    want = {}
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        cut = len(t) // 4
        want[i] = t[: len(t) - cut] + after[:cut]
    for parts in (1, 7):
        after = fingerprints.with_next_text(docs, parts=parts)
        got = {r["doc_id"]: r["e"] for r in after.select("doc_id", fingerprints.edited("text", "next_text").alias("e")).collect()}
        assert got == want
    for r in fingerprints.compare_edits(docs).collect():
        assert r["edited"] == want[r["doc_id"]]
        assert 0 <= r["near_next"] <= 1


def test_fingerprint_likeness_follows_jaccard(spark):
    base = [f"w{i}" for i in range(2000)]
    rows = [(0, " ".join(base)), (1, " ".join(base[:1500] + [f"x{i}" for i in range(500)])), (2, " ".join(base).upper()), (3, ""), (4, None)]
    found = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sig = {k: np.frombuffer(bytes.fromhex(v), ">u2") for k, v in found.items()}
    assert found[0] == found[2] and found[3] == found[4]
    assert (sig[0] == sig[1]).mean() == pytest.approx(1496 / 2496, abs=0.13)


def test_fingerprints_of_hard_rows(docs, nothing):
    assert fingerprints.compare_edits(docs).count() == len(TEXTS)
    assert fingerprints.compare_edits(nothing).count() == 0
    assert fingerprints.fingerprints(docs).count() == len(TEXTS)


def test_banded_pairs_are_verified(spark):
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base[:280] + [f"v{i}_{j}" for j in range(i * 20)])) for i in range(6)] + [(9, "apart from all the others here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    for r in fingerprints.near_pairs(docs).collect():
        x, y = sets[r["doc_id"]], sets[r["hub"]]
        assert (r["intersection"], r["union"]) == (len(x & y), len(x | y)) and len(x & y) >= 0.8 * len(x | y)
    assert {r["doc_id"] for r in fingerprints.near_pairs(docs).collect()} >= {1, 2}


@pytest.mark.parametrize("block", [384, 1])
def test_pairs_beside_their_hub_are_verified(spark, monkeypatch, block):
    # with blocks of one every family is a large one
    monkeypatch.setattr(forest, "BLOCK_ROWS", block)
    # groups of hub, x, y, copy of y: x and y are near each other but not near the hub
    rows = []
    for g in range(12):
        word = lambda part, n: [f"g{g}{part}{i}" for i in range(n)]
        shared = word("s", 300)
        x, y = shared + word("m", 60) + word("x", 20), shared + word("m", 60) + word("y", 20)
        rows += [(4 * g, " ".join(shared + word("h", 60))), (4 * g + 1, " ".join(x)), (4 * g + 2, " ".join(y)), (4 * g + 3, " ".join(y))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = {(r["doc_id"], r["hub"]): r["intersection"] / r["union"] for r in fingerprints.near_pairs(docs).collect()}
    assert set(pairs) == {p for g in range(12) for p in ((4 * g + 2, 4 * g + 1), (4 * g + 3, 4 * g + 2))}
    assert all(0.8 <= pairs[4 * g + 2, 4 * g + 1] < 1 == pairs[4 * g + 3, 4 * g + 2] for g in range(12))
    near = {r["doc_id"]: r["near_doc"] for r in fingerprints.with_near(docs.select("doc_id"), docs).collect()}
    assert all([near[4 * g + j] for j in range(4)] == [None, 4 * g + 2, 4 * g + 3, 4 * g + 2] for g in range(12))


def test_unlike_sets_of_a_band_are_no_family(spark, monkeypatch):
    # any two of these share a third of their shingles, which makes bands meet by chance; 100 and 101 are near
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base + [f"v{i}_{j}" for j in range(190)])) for i in range(60)]
    rows += [(100 + i, " ".join([f"y{j}" for j in range(200)] + ["tail"] * i)) for i in range(2)]
    seen, verified = [], fingerprints._verified
    keep = lambda keyed, families, percent: seen.append({r["id"] for r in families.collect()}) or verified(keyed, families, percent)
    monkeypatch.setattr(fingerprints, "_verified", keep)
    pairs = [(r["doc_id"], r["hub"]) for r in fingerprints.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert pairs == [(101, 100)] and seen == [{100, 101}]


def test_pairs_of_crowded_bands_are_verified(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 2)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base + [f"v{i}_{j}" for j in range(10)])) for i in range(12)] + [(5, " ".join(base + [f"v5_{j}" for j in range(10)]))]
    found = fingerprints.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {i for r in found for i in (r["doc_id"], r["hub"])} == set(range(12)) and len(found) == 11


def test_notes_travel_with_their_documents(spark):
    rows = [(i, f"text {i} " * (i % 5)) for i in range(0, 90, 2)] + [(None, "no key"), (8, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    notes = spark.createDataFrame([(i, i + 1) for i in range(0, 95, 3)], "doc_id long, note int")
    for parts in (1, 7):
        plain = fingerprints.with_next_text(docs, parts=parts).drop("note").collect()
        noted = fingerprints.with_next_text(docs, parts=parts, notes=notes).collect()
        assert Counter(map(tuple, plain)) == Counter((r["doc_id"], r["text"], r["next_text"]) for r in noted)
        assert all(r["note"] == (r["doc_id"] + 1 if r["doc_id"] is not None and r["doc_id"] % 3 == 0 else None) for r in noted)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the generated tables")
def test_fingerprint_query_names_every_near_document(spark):
    path = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    words = {i: words_of((t or "").lower()) for i, t in texts.items()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    like = lambda i, j: len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j]))
    want = {i for i in sets if any(j != i and like(i, j) >= 0.8 for j in sets)}
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_fingerprints"](spark, path).collect()}
    assert set(got) == set(texts) and want and {i for i, r in got.items() if r["near_doc"] is not None} == want
    assert all(got[i]["near_shared"] / got[i]["near_union"] == like(i, got[i]["near_doc"]) >= 0.8 for i in want)


# --- 7 -----------------------------------------------------------------------------------


def test_tokens_equal_the_rank_library(docs, nothing):
    import tiktoken

    path, pattern = queries.rank_file()
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=tokens.read_ranks(path), special_tokens={})
    coded = tokens.encode(docs, path, pattern, offsets=True)
    back = tokens.decode(coded, path)
    for r in back.collect():
        text = r["text"] or ""
        assert r["ids"] == reference.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()
        pieces = [reference.decode_single_token_bytes(i) for i in r["ids"]]
        at = 0
        for piece, s, e in zip(pieces, r["starts"], r["ends"]):
            # the characters a token touches hold its bytes
            whole = text[s:e].encode()
            begin = at - len(text[:s].encode())
            assert whole[begin : begin + len(piece)] == piece
            at += len(piece)
    assert tokens.decode(tokens.encode(nothing, path, pattern), path).count() == 0
    # one pass gives the same rows
    both = tokens.encode_decode(docs, path, pattern)
    row = lambda r: (r["doc_id"], tuple(r["ids"]), bytes(r["decoded"]))
    assert Counter(map(row, both.collect())) == Counter(map(row, back.collect()))
    assert all(np.frombuffer(r["packed"], "<u4").tolist() == r["ids"] for r in both.collect())
    assert tokens.encode_decode(nothing, path, pattern).count() == 0
    digests = queries.id_digests(both).collect()
    assert len(digests) == len(TEXTS)
    assert {r["decoded_sha256"] for r in digests} == {hashlib.sha256((t[1] or "").encode()).hexdigest() for t in TEXTS}


# --- 9 -----------------------------------------------------------------------------------


def test_suffix_array_by_induction():
    rng = np.random.default_rng(2)
    for trial in range(150):
        n, k = int(rng.integers(0, 70)), int(rng.integers(1, 5))
        t = rng.integers(97, 97 + k, n).astype(np.uint8)
        if trial % 4 == 0 and n:
            t = np.tile(t[: max(1, n // 4)], 4)
        b = t.tobytes()
        order = suffix_array.suffix_array(t)
        assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        shared = suffix_array.common_prefixes(t, order)
        for r in range(1, len(order)):
            assert shared[r] == len(os.path.commonprefix([b[order[r - 1] :], b[order[r] :]]))


def cut_plain(texts, length):
    seen, repeated = {}, set()
    data = [(t or "").encode() for t in texts]
    for i, b in enumerate(data):
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                repeated |= {(i, s), seen[w]}
            else:
                seen[w] = (i, s)
    out = []
    for i, b in enumerate(data):
        gone = np.zeros(len(b) + 1, bool)
        for j, s in repeated:
            if i == j:
                gone[s : s + length] = True
        gone = gone[: len(b)]
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("hot", [1 << 20, 100])
def test_cut_against_plain(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_BYTES", hot)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 2000)
    rng = np.random.default_rng(8)
    passage = ["".join(rng.choice(list("abcd é"), 90)) for _ in range(4)]
    texts = ["".join(rng.choice(list("abcde 🎉"), 60)) + passage[rng.integers(4)] + "".join(rng.choice(list("xyz"), 40)) for _ in range(40)]
    texts += [texts[0], texts[0], None, "", "ab" * 100, "the " * 60, passage[0] + passage[0], "short"]
    docs = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = Counter((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.cut(docs, length=40, gram=8).collect())
    assert got == Counter(cut_plain(texts, 40))


def test_cut_of_hard_rows(docs, nothing, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 1 << 15)
    got = Counter((r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.md5(bytes(r["kept"])).hexdigest()) for r in repeats.cut(docs, length=200).collect())
    want = Counter((a, b, c, hashlib.md5(d).hexdigest()) for a, b, c, d in cut_plain([t[1] for t in TEXTS], 200))
    assert got == want
    assert repeats.cut(nothing).count() == 0


def test_passages_of_many_words_go_from_400_bytes_on(spark):
    passage = lambda name, size: (" ".join(f"{name}{i}" for i in range(200))[: size - 1]) + "."
    short, long = passage("s", 399), passage("l", 400)
    assert min(len(short.split()), len(long.split())) > 50
    rows = [(1, "<" + short + "="), (2, ">" + short + "+"), (3, "(" + long + "["), (4, ")" + long + "]")]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.cut(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, 0, rows[0][1].encode()), 2: (0, 0, rows[1][1].encode()), 3: (400, 1, b"(["), 4: (400, 1, b")]")}


def sharing_plain(rows, words):
    """Keys of documents with a passage of so many words that another document has."""
    held = {}
    for key, text in rows:
        ws = words_of(text)
        for i in range(len(ws) - words + 1):
            held.setdefault(tuple(ws[i : i + words]), set()).add(text if key is None else key)
    return set().union(*(keys for keys in held.values() if len(keys) > 1))


def test_passages_of_many_words_are_told_below_400_bytes(spark, tmp_path):
    few, many = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("f", 50), ("m", 51)))
    assert len(many) < 400
    rows = [(1, f"x {few} y"), (2, f"z {few} t"), (3, f"a b {many} c"), (4, many.replace(" ", "\n\n") + " d"), (5, many.upper()), (6, f"{few} q {few}"), (7, None), (8, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["shares_passage"], r["has_repeats"]) for r in queries.QUERIES["op9_suffix_array"](spark, str(tmp_path)).collect()}
    assert got == {i: (i in (3, 4), False) for i in range(1, 9)}


@pytest.mark.parametrize("step", [1 << 20, 40])
def test_sharing_against_plain(spark, nothing, monkeypatch, step):
    monkeypatch.setattr(passages, "SLICE", step)
    rng = np.random.default_rng(9)
    draw = lambda n, kinds: " ".join(f"w{i}" for i in rng.integers(0, kinds, n))
    passage = [draw(int(n), 50) for n in rng.integers(9, 20, 12)]
    texts = [f"{draw(30, 60)} {passage[rng.integers(12)]} {draw(int(rng.integers(200)), 60)} {passage[rng.integers(12)]}" for _ in range(60)]
    # as few words as there are anchors of many contexts
    texts += [draw(300, 2) for _ in range(4)] + ["the " * 60, f"the {passage[0]} " * 3, passage[0], passage[1] + " x", "", None]
    rows = [(None if i in (3, 64) else i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (5, texts[6]), (200, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = {r["row_id"]: r["doc_id"] for r in repeats.cut(docs, length=40, gram=8).collect()}
    for words, gram in ((12, 3), (12, 12), (10, 1)):
        got = [r["row_id"] for r in passages.sharing(docs, words=words, gram=gram).collect()]
        want = sharing_plain(rows, words)
        assert len(got) == len(set(got)) and 20 < len(want)
        assert {i for i in got if i < 1 << 62} == {k for k in want if isinstance(k, int)}
        assert sum(ids[i] is None for i in got) == sum(isinstance(k, str) for k in want)
    assert passages.sharing(nothing).count() == 0


# --- 10 ----------------------------------------------------------------------------------


def near_plain(rows, k, percent=80):
    def shingled(t):
        w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = [shingled(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return Counter((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows))


def family(rng, size, base, drop):
    return [" ".join(w if rng.random() > drop * rng.random() else f"n{rng.integers(10**9)}" for w in base) for _ in range(size)]


@pytest.mark.parametrize("small", [False, True])
def test_groups_against_all_pairs(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(forest, "REGION_ROWS", 6)
        monkeypatch.setattr(forest, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(4):
        texts += family(rng, 45, [f"b{rng.integers(400)}" for _ in range(120)], 0.16)
    texts += [texts[0]] * 5 + [f"lone {i} text of its own {i * 7}" for i in range(30)] + ["Same Words here", "same words HERE", "one", "ONE", "", None, "  "]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    found = forest.groups(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == near_plain(rows, 2)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_groups_of_hard_rows(docs, nothing):
    found = forest.groups(docs, k=5).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == near_plain([(t[0], t[1]) for t in TEXTS], 5)
    kept = forest.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 3, 4, 5, None, 6, 8, 9, 11, 12, 13])
    assert forest.groups(nothing).count() == 0 and forest.keep_one(nothing).count() == 0


def test_smallest_reachable_on_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert table(forest.smallest_reachable(links)) == Counter([(i, 0) for i in range(41)] + [(100, 100), (101, 100)])
