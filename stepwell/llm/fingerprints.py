"""MinHash fingerprints of documents: likeness of texts without the texts.

Words become 64-bit hashes, windows of five words become shingles, and ``PERMUTATIONS``
universal hash functions over the shingles keep their minima, all in numpy over Arrow
batches.  A fingerprint is the minima's 16-bit forms as hexadecimal text.  ``near_pairs``
joins signature bands in Spark and verifies the Jaccard likeness on the full shingle sets;
documents that share a band and have like minima are tied, what ties connect is a family, and
inside a family every pair that could still join two groups is verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwell.llm import forest
from stepwell.llm.textkit import discard, distinct_by_text, minhashes, mix64, permutations, shingles, span_hashes, stored, text_blocks, word_spans

# a pair at a likeness of 0.8 shares none of 32 bands of 4 with a chance of 5e-8
PERMUTATIONS, BANDS = 128, 32
SHINGLE, SEED = 5, 3
# the minima of a near pair agree at least so far below the threshold (seven sigma)
TIE_SLACK = 0.25
# a band shared by more sets is cut by a second band
BUCKET_ROWS = 4096


def _sets(column: pa.Array, k: int = SHINGLE):
    for lo, hi, data, offsets in text_blocks(column):
        starts, ends, owner = word_spans(data, offsets)
        values, of = shingles(span_hashes(data, starts, ends, fold=True), owner, k, hi - lo)
        yield lo, hi, *distinct_by_text(values, of, hi - lo)


def signature_matrix(column: pa.Array) -> np.ndarray:
    """(texts, PERMUTATIONS) 16-bit minima; texts without words have 0xFFFF everywhere."""
    a, b = permutations(PERMUTATIONS, SEED)
    parts = [(minhashes(values, bounds, a, b) >> np.uint32(16)).astype(np.uint16) for _, _, values, bounds in _sets(column)]
    return np.concatenate(parts) if parts else np.zeros((0, PERMUTATIONS), np.uint16)


def _hex(matrix: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in matrix.astype(">u2")]


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal minima, row by row: an estimate of the Jaccard likeness."""
    return (x == y).mean(axis=1)


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """Append the fingerprint of ``text`` (a column of that name is replaced).

    Equal texts have equal fingerprints, also apart from upper and lower case.  NULL, empty
    and blank texts share the fingerprint of the empty set; a text with fewer than five
    words has one shingle, all its words.  Repeated rows stay, an empty table stays empty.
    """
    keep = [c for c in docs.columns if c != into]
    whole = docs.select(F.struct(*[docs[c] for c in keep]).alias("_row"), docs[text].alias("_text"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_hex(signature_matrix(batch.column(1))))], names=["_row", into])

    schema = f"_row {whole.schema['_row'].dataType.simpleString()}, `{into}` string"
    return whole.mapInArrow(run, schema).select(*[F.col("_row").getField(c).alias(c) for c in keep], into)


def with_next_text(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None, notes: DataFrame | None = None) -> DataFrame:
    """(key, text, next_text, note): every document and the one after it by key; the last, the first.

    The keys are cut at quantiles, which are keys themselves; the document at a cut goes
    also to the range before it, so each range knows the successors of all its documents
    and every text is shuffled once.  NULL keys come last; rows with equal keys are ordered
    by a hash of their text.  ``notes`` are rows (key, note), one per key at most: they travel
    in the same shuffle just before their document, so no text is shuffled to join them.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rank = F.coalesce(F.col("_key").cast("double"), F.lit(float("inf")))
    rows = docs.select(docs[key].cast("long").alias("_key"), F.coalesce(docs[text], F.lit("")).alias("_text"))
    if notes is None:
        notes = rows.limit(0).select(F.col("_key").alias(key), F.lit(None).cast("int").alias("note"))
    blank = F.lit(None).cast(notes.schema["note"].dataType)
    cuts = rows.stat.approxQuantile("_key", [i / parts for i in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []
    cuts = sorted(set(cuts))
    is_text = F.col("_text").isNotNull()
    order = F.struct(F.col("_key").isNull().alias("n"), F.col("_key").alias("k"), F.when(is_text, F.xxhash64("_text")).alias("h"))
    first = rows.agg(F.min(order).alias("f")).first()["f"]
    if first is None:
        return rows.select(F.col("_key").alias(key), F.col("_text").alias("text"), F.lit("").alias("next_text"), blank.alias("note"))
    noted = notes.select(F.col(key).cast("long").alias("_key"), F.lit(None).cast("string").alias("_text"), F.struct(F.col(key).cast("long").alias("k"), "note").alias("_note"))
    ranged = rows.withColumn("_note", F.lit(None).cast(noted.schema["_note"].dataType)).union(noted).withColumn("_rank", rank)
    if cuts:
        edges = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_rank", outputCol="_range", handleInvalid="keep")
        ranged = edges.transform(ranged).withColumn("_range", F.least(F.col("_range"), F.lit(float(len(cuts)))))
    else:
        ranged = ranged.withColumn("_range", F.lit(0.0))
    is_first = order.eqNullSafe(F.struct(F.lit(first["n"]), F.lit(first["k"]).cast("long"), F.lit(first["h"]))) & is_text
    at_cut = F.col("_rank").isin(*cuts) & is_text if cuts else F.lit(False)
    # (range, 0 own row, 1 successor of the range, 2 successor of all)
    own = F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("role")))
    before = F.when(at_cut, F.array(F.struct((F.col("_range") - 1).alias("r"), F.lit(1).alias("role")))).otherwise(F.array().cast("array<struct<r:double,role:int>>"))
    around = F.when(is_first, F.array(F.struct(F.lit(float(len(cuts))).alias("r"), F.lit(2).alias("role")))).otherwise(F.array().cast("array<struct<r:double,role:int>>"))
    dealt = ranged.withColumn("_to", F.explode(F.concat(own, before, around)))
    following = Window.partitionBy("_to.r").orderBy("_to.role", order)
    latest = F.last("_note", ignorenulls=True).over(following.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = dealt.withColumns({"next_text": F.expr("lead(_text) IGNORE NULLS").over(following), "_note": latest}).filter("_to.role = 0 AND _text IS NOT NULL")
    note = F.when(F.col("_note.k") == F.col("_key"), F.col("_note.note"))
    return found.select(F.col("_key").alias(key), F.col("_text").alias("text"), "next_text", note.alias("note"))


def edited(text: str, following: str):
    """The text with its last quarter replaced by as much of the beginning of another."""
    length = F.length(text)
    cut = F.floor(length / 4).cast("int")
    return F.concat(F.substr(F.col(text), F.lit(1), length - cut), F.substr(F.col(following), F.lit(1), cut))


def compare_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", notes: DataFrame | None = None) -> DataFrame:
    """Per document: key, text, edited text, both fingerprints, near_edited, near_next and note.

    The likenesses are those of the fingerprint to the edited text's and to the next
    document's.  The cases are those of ``fingerprints`` and ``with_next_text``.
    """
    rows = with_next_text(docs, key, text, notes=notes).withColumn("edited", edited("text", "next_text"))
    names = [key, "note", "text", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                if not part.num_rows:
                    continue
                ids, note, own, new, after = part.columns
                # a successor is mostly the next row of the batch: hash each text once
                once = pa.chunked_array([own, after, new]).dictionary_encode().unify_dictionaries()
                dictionary = once.chunk(0).dictionary
                matrix = signature_matrix(dictionary)
                x, z, y = (matrix[c.indices.to_numpy()] for c in once.chunks)
                found = [pa.array(_hex(x)), pa.array(_hex(y)), pa.array(likeness(x, y)), pa.array(likeness(x, z))]
                yield pa.RecordBatch.from_arrays([ids, note, own, new, *found], names=names)

    schema = f"`{key}` long, note {rows.schema['note'].dataType.simpleString()}, text string, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.select(key, "note", "text", "edited", "next_text").mapInArrow(run, schema)


def _marks(keyed: DataFrame) -> DataFrame:
    """Per row of (id, text) with words: id, size and 128-bit hash of the set, marks of its bands, a byte of each minimum."""

    def run(batches):
        a, b = permutations(PERMUTATIONS, SEED)
        width = PERMUTATIONS // BANDS
        for batch in batches:
            for lo, hi, values, bounds in _sets(batch.column(1)):
                full = np.flatnonzero(np.diff(bounds))
                if not len(full):
                    continue
                sig = (minhashes(values, bounds, a, b)[full] >> np.uint32(16)).astype(np.uint64)
                marks = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(full), BANDS)).copy()
                for j in range(width):
                    marks = mix64(marks * np.uint64(3) + sig[:, j::width] + np.uint64(1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * BANDS, pa.int32()), pa.array(marks.ravel().view(np.int64)))
                hashes = [np.add.reduceat(mix64(values ^ np.uint64(x)), bounds[full]).view(np.int64) for x in (0, 0x5851F42D4C957F2D)]
                ids = batch.column(0).slice(lo, hi - lo).take(pa.array(full))
                low = forest._binary((sig & np.uint64(0xFF)).astype(np.uint8), np.arange(len(full) + 1) * PERMUTATIONS)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds)[full]), *map(pa.array, hashes), lists, low], names=["id", "n", "set_a", "set_b", "marks", "sig"])

    return keyed.mapInArrow(run, "id long, n long, set_a long, set_b long, marks array<long>, sig binary")


def _shared(marked: DataFrame, percent: int) -> DataFrame:
    """(mark, id, n, members): rows with another set of the mark whose size allows a near pair."""
    by_size = Window.partitionBy("mark").orderBy("n")
    fits = (100 * F.lag("n").over(by_size) >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.lead("n").over(by_size))
    some = marked.select("mark", "id", "n", F.coalesce(fits, F.lit(False)).alias("fits")).filter("fits").dropDuplicates(["mark", "id"])
    return some.select("mark", "id", "n", F.count("*").over(Window.partitionBy("mark")).alias("members"))


def _forest(sig: np.ndarray, n: np.ndarray, least: float, percent: int) -> list[tuple[int, int]]:
    """Pairs of rows that connect all whose minima agree in ``least`` of their places and whose sizes allow it."""
    edges, rest = [], np.arange(len(sig))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            like = np.count_nonzero(sig[rest] == sig[x], axis=1) >= least * sig.shape[1]
            like &= 100 * np.minimum(n[rest], n[x]) >= percent * np.maximum(n[rest], n[x])
            found, rest = rest[like], rest[~like]
            edges += [(x, y) for y in found]
            queue += list(found)
    return edges


def _ties(signed: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of rows (mark, id, n, sig): a spanning forest of the like sets of each mark."""
    least = percent / 100 - TIE_SLACK

    def run(batches):
        for table in forest._groups(batches, 1):
            cuts = forest._bounds(table, 1)
            ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
            sig = forest._matrix(table.column("sig"))
            # most marks have two sets: those are neighbours
            two = cuts[:-1][np.diff(cuts) == 2]
            like = np.count_nonzero(sig[two] == sig[two + 1], axis=1) >= least * PERMUTATIONS
            pairs = [np.stack([two[like], two[like] + 1], axis=1)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi - lo > 2 and (edges := _forest(sig[lo:hi], n[lo:hi], least, percent)):
                    pairs.append(np.array(edges) + lo)
            links = np.sort(ids[np.concatenate(pairs)], axis=1)
            if len(links):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in links.T.copy()], names=["a", "b"])

    dealt = signed.select("mark", "id", "n", "sig").repartition("mark").sortWithinPartitions("mark", "n", "id")
    return dealt.mapInArrow(run, "a long, b long").filter("a < b")


def _families(rows: DataFrame, left: DataFrame, percent: int) -> DataFrame:
    """(id, label) of the sets that ties connect; ``left`` is what of ``rows`` takes part."""
    shared = stored(_shared(left.select("id", "n", F.explode("marks").alias("mark")), percent))
    cold = shared.filter(F.col("members") <= BUCKET_ROWS)
    hot = shared.filter(F.col("members") > BUCKET_ROWS).select("mark", "id", "n")
    if not hot.isEmpty():
        other = rows.select("id", "marks").join(forest._sized(hot), "id").select("mark", "id", "n", F.explode("marks").alias("other"))
        both = F.xxhash64(F.least("mark", "other"), F.greatest("mark", "other"))
        cold = cold.union(_shared(other.filter("mark <> other").select("id", "n", both.alias("mark")), percent))
    signed = cold.join(rows.groupBy("id").agg(F.first("sig").alias("sig")), "id")
    return forest.smallest_reachable(_ties(signed, percent).distinct())


def near_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """(key, hub, intersection, union): verified pairs that connect all near documents.

    Two documents are near when 100 * intersection >= ``percent`` * union on the full shingle
    sets.  Documents with equal minima in a band are compared by a byte of each minimum and
    their sizes; those that may be near are connected by ties, at most one per document and
    band.  What ties connect is a family: a near pair that shares a band (two, where more than
    ``BUCKET_ROWS`` sets share one) is inside one.  There every pair is verified unless its ends
    are connected by verified pairs already, so a document has a row (as ``key`` or ``hub``, the
    smaller of the two) exactly if it is near to another.  Equal sets give one pair per copy.
    Repeated rows count once; otherwise keys are distinct.  Rows without a key and documents
    without words are in no pair.
    """
    keyed = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text")).filter("id IS NOT NULL")
    rows = stored(_marks(keyed))
    same = ["set_a", "set_b", "n"]
    firsts = stored(rows.groupBy(*same).agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter("hub < last").drop("last"))
    copies = stored(rows.select("id", *same).join(firsts, same).filter("id <> hub").select("id", "hub", "n").distinct())
    left = rows.join(forest._sized(copies.select("id").distinct()), "id", "left_anti")
    families = _families(rows, left, percent)
    discard(rows, firsts)
    links = _verified(keyed, families, percent).groupBy("a", "b").agg(F.max(F.struct("shared", "total")).alias("_c"))
    checked = links.select(F.col("b").alias(key), F.col("a").alias("hub"), F.col("_c.shared").alias("intersection"), F.col("_c.total").alias("union"))
    return checked.union(copies.select(F.col("id").alias(key), "hub", F.col("n").alias("intersection"), F.col("n").alias("union")))


def _verified(keyed: DataFrame, families: DataFrame, percent: int) -> DataFrame:
    """Links (a, b, shared, total) that connect all near sets of each family.

    A family that fits a block is settled there, its sets going straight from the texts into
    the shuffle.  Large families are dealt into blocks twice; members outside the largest
    group are then compared with the whole family (see ``forest``), first by signatures.
    """
    least = percent / 100 - forest.SLACK
    sizes = stored(families.groupBy("label").agg(F.count("*").alias("members")))
    wanted = stored(families.join(forest._sized(sizes), "label").select("id", F.col("label").alias("family"), "members"))
    own = {"part": F.col("id"), "side": F.lit(1)}
    small = stored(wanted.filter(F.col("members") <= forest.BLOCK_ROWS))
    settled = forest.full_sets(keyed, small, SHINGLE, True, SEED).withColumns({"block": F.lit(0).cast("long"), **own})
    links = stored(forest._confirm(settled, percent, least, counts=True))
    discard(small)
    large = stored(wanted.filter(F.col("members") > forest.BLOCK_ROWS))
    if not large.isEmpty():
        nodes = stored(forest.full_sets(keyed, large, SHINGLE, True, SEED).withColumn("blocks", F.ceil(F.col("members") / forest.BLOCK_ROWS)))
        dealt = nodes.withColumn("deal", F.explode(F.array(*[F.lit(d) for d in range(forest.DEALS)])))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id", "deal"), F.col("blocks")) * forest.DEALS + F.col("deal"))
        first = stored(forest._confirm(dealt.withColumns(own), percent, least, counts=True))
        known = nodes.join(forest._sized(forest.smallest_reachable(first)), "id", "left").withColumn("part", F.coalesce("label", "id")).drop("label")
        # signatures go to all blocks, full sets only where a signature of another group is near
        place = F.struct("family", "block", "part", "side")
        near = stored(forest._worth_reading(forest._against_rest(known.drop("set")), least).groupBy("id").agg(F.collect_list(place).alias("at")))
        discard(sizes)
        again = nodes.select("id", "sig", "set").join(forest._sized(near), "id").withColumn("at", F.explode("at")).select("id", "sig", "set", "at.*")
        rest = stored(forest._confirm(again, percent, least, sides=True, counts=True))
        discard(nodes)
        links = links.union(first).union(rest)
    return links


def likest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, note): the likest verified partner of each document that has one.

    The note is a struct of ``o``, the partner, and the sizes of intersection and union; of
    equally like partners the smallest key is named.
    """
    pairs = stored(near_pairs(docs, key, text))
    ways = pairs.select(F.col(key).alias("_k"), F.col("hub").alias("o"), "intersection", "union")
    ways = ways.union(pairs.select(F.col("hub").alias("_k"), F.col(key).alias("o"), "intersection", "union"))
    best = F.max_by(F.struct("o", "intersection", "union"), F.struct(F.col("intersection") / F.col("union"), -F.col("o")))
    found = stored(ways.groupBy(F.col("_k").alias(key)).agg(best.alias("note")))
    discard(pairs)
    return found


def near_columns(note: str) -> list[Column]:
    """near_doc, near_shared and near_union of a note of ``likest``."""
    names = {"o": "near_doc", "intersection": "near_shared", "union": "near_union"}
    return [F.col(note).getField(c).alias(name) for c, name in names.items()]


def with_near(rows: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Append near_doc, near_shared and near_union: the likest verified partner of each key.

    NULL where no document is near; of equally like partners the smallest key is named.
    """
    near = forest._sized(likest(docs, key, text).select(F.col(key).alias("_k"), F.col("note").alias("_b")))
    return rows.join(near, rows[key] == F.col("_k"), "left").select(*[rows[c] for c in rows.columns], *near_columns("_b"))
