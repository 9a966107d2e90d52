"""Near-duplicates by one-permutation MinHash with optimal densification.

A text's set is its distinct 4-word shingles. Texts of the same set are one
class from the start. A class has BINS minima out of a single pass over its
hashes; bins that got none borrow from others along a fixed order of probes.
BANDS keys of ROWS bins each put it into buckets. In a bucket only a star is
compared: every member with the one member that shares most buckets with
others. What the stars leave apart, the members of a bucket outside its largest
component, meets the rest of the bucket in bounded blocks, where signatures are
compared in place; whoever is likely to be linked belongs to one family, and the
full sets of a family meet in blocks again. So no link between components is
lost to the stars, and no list of pairs is ever longer than its rows. All links
are confirmed on the full sets.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import blocks, textvec
from weftline.llm.components import components
from weftline.llm.runtime import checked_broadcast, kept, may_be_in, sizes_unpacked, small_batches

#: Two sets with J = 0.8 miss every one of the 32 buckets with probability (1 - 0.8^4)^32 = 5e-8.
BINS, BANDS, ROWS = 128, 32, 4
SHINGLE = 4

#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80

#: Rows of the two sides of a block: signatures of a bucket, and full sets of a family.
LESS, MORE = 256, 512
LESS_SETS, MORE_SETS = 64, 128

#: Pairs of one centre that are looked at in one place.
CENTRE_PAIRS = 1_024

#: Rows of ids that are broadcast to find texts or rows by; beyond, bits are, and what they let through is shuffled.
IDS_AT_ONCE = 200_000

#: A pair is looked at on its full sets unless its signatures are so many standard deviations below the limit.
DEVIATIONS = 6.0


def probes() -> np.ndarray:
    """For each bin, the order in which an empty bin asks the others: a row per attempt, fixed for all texts."""
    rng = np.random.default_rng(20170806)
    return np.array([rng.permutation(BINS) for _ in range(BINS)]).T


def signatures(hashes: np.ndarray, rows: np.ndarray, n_rows: int, order: np.ndarray) -> np.ndarray:
    """n_rows x BINS minima. hashes are sorted within each row, and a hash's highest bits name its bin; rows without hashes stay 0."""
    none = np.uint64(0)
    sig = np.zeros((n_rows, BINS), dtype=np.uint64)
    full = np.zeros((n_rows, BINS), dtype=bool)
    bins = (hashes >> np.uint64(64 - (BINS - 1).bit_length())).astype(np.int64)
    first = np.r_[True, (bins[1:] != bins[:-1]) | (rows[1:] != rows[:-1])] if len(bins) else np.zeros(0, bool)
    sig[rows[first], bins[first]] = hashes[first]
    full[rows[first], bins[first]] = True
    some = full.any(axis=1)
    r, c = np.nonzero(~full & some[:, None])
    base = sig.copy()
    for attempt in order:
        if not len(r):
            break
        asked = attempt[c]
        got = full[r, asked]
        sig[r[got], c[got]] = base[r[got], asked[got]]
        r, c = r[~got], c[~got]
    sig[~some] = none
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """n x BANDS bucket keys, different bands never alike."""
    key = np.zeros((len(sig), BANDS), dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(ROWS):
        key = textvec.mix64(key + sig[:, k * BANDS : (k + 1) * BANDS])
    return key


def _bytes(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(rows.strides[0]), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = probes()
    for batch in batches:
        row, texts = batch.column(0), batch.column(1)
        for a, b, data, starts in textvec.chunks(texts):
            h, r = textvec.shingles(*textvec.word_hashes(data, starts), SHINGLE)
            n = b - a
            size = np.bincount(r, minlength=n)
            lo, hi = _names_of_sets(h, r, n)
            sig = signatures(h, r, n, order)
            keys = _bytes(band_keys(sig))
            small = _bytes((textvec.mix64(sig) >> np.uint64(56)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([row.slice(a, n), pa.array(size, pa.int64()), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)), keys, small], names=["row", "n", "lo", "hi", "bands", "sig"])


def _names_of_sets(h: np.ndarray, r: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each row's set, whatever the order of its hashes."""
    lo, hi = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    np.add.at(lo, r, textvec.mix64(h + np.uint64(1)))
    np.add.at(hi, r, textvec.mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    return lo, hi


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, lo, text) -> (id, hashes) of the texts whose set is the one that lo names."""
    for batch in batches:
        ids, wanted, texts = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
        for a, b, data, starts in textvec.chunks(texts):
            h, r = textvec.shingles(*textvec.word_hashes(data, starts), SHINGLE)
            lo, _ = _names_of_sets(h, r, b - a)
            ends = np.r_[0, np.cumsum(np.bincount(r, minlength=b - a))].astype(np.int32)
            found = pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], names=["id", "hashes"])
            yield found.filter(pa.array(lo.view(np.int64) == wanted[a:b]))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, bands) -> a row per band."""
    for batch in batches:
        blob = batch.column(1)
        keys = np.frombuffer(b"".join(blob.to_pylist()), dtype=np.int64) if len(blob) else np.zeros(0, np.int64)
        ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids)], names=["key", "id"])


def _text_key() -> Column:
    return F.xxhash64(F.lit(17), "text")


def _few(ids: DataFrame) -> bool:
    """Whether written ids are few enough for a broadcast."""
    return ids.limit(IDS_AT_ONCE + 1).count() <= IDS_AT_ONCE


def _without(rows: DataFrame, ids: DataFrame, keys: list[str], how: str = "left_anti") -> DataFrame:
    """rows whose keys aren't among written ids, or with left_semi those whose are; rows that the bits already settle aren't shuffled."""
    if _few(ids):
        return rows.join(F.broadcast(ids), keys, how)
    told = may_be_in(rows, F.col(keys[0]), ids, F.col(keys[0]))
    met = told.where("maybe").drop("maybe").join(ids, keys, how)
    return met if how == "left_semi" else told.where("NOT maybe").drop("maybe").unionByName(met)


def _full_sets(ids: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, hashes) of some classes. Only the text of each class's representative is read into a set."""
    asked = kept(ids.join(reps.select("id", "lo", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key")), "id"), "nd-asked")
    texts = docs.select("doc_id", "text", _text_key().alias("text_key"))
    few = _few(asked)
    if not few:
        texts = may_be_in(texts, F.col("text_key"), asked, F.col("rep_key")).where("maybe").drop("maybe")
    wanted = texts.join(F.broadcast(asked) if few else asked, (F.col("text_key") == F.col("rep_key")) & F.col("doc_id").eqNullSafe(F.col("rep_id")))
    return kept(wanted.select("id", "lo", "text").mapInArrow(_sets, "id bigint, hashes array<bigint>").dropDuplicates(["id"]), "nd-sets")


def _confirmed(star: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b), a the lesser: those of the pairs (id, centre) whose full sets are alike enough.

    A member is in a pair for each of its bands at most, so its set travels with its
    pairs; a centre may be in any number of them. Its pairs are dealt into parts of
    about CENTRE_PAIRS, and its set goes once to each part.
    """
    sets = _full_sets(star.select("id").union(star.select("centre")).distinct(), reps, docs)
    famous = star.groupBy("centre").agg(F.count("*").alias("n")).where(F.col("n") > CENTRE_PAIRS)
    famous = kept(famous.select("centre", F.ceil(F.col("n") / CENTRE_PAIRS).cast("int").alias("parts")), "nd-famous")
    parts = checked_broadcast(famous)
    dealt = star.join(parts, "centre", "left").select("id", "centre", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64(F.lit(31), "id"), F.col("parts"))).otherwise(0).alias("part"))
    centres = sets.select(F.col("id").alias("centre"), F.col("hashes").alias("of_b")).join(parts, "centre", "left")
    centres = centres.select("centre", "of_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)).cast("bigint") - 1)).alias("part"))
    both = dealt.join(sets.select("id", F.col("hashes").alias("of_a")), "id").join(centres, ["centre", "part"])
    common = F.size(F.array_intersect("of_a", "of_b"))
    alike = both.withColumn("common", common).where(100 * F.col("common") >= PERCENT * (F.size("of_a") + F.size("of_b") - F.col("common")))
    return _ordered(alike)


def _by_size(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """(key, id) of bucket rows (key, id, n): buckets beyond a block are parted by the size of the sets.

    Sets of a similarity of PERCENT or more differ in size by no more than that
    share, so they lie in the same class of sizes or in neighbouring ones; a set
    goes to the bucket of its class and to that of the next one.
    """
    few = rows.where(F.col("n") <= MORE).select("key", "id")
    many = rows.where(F.col("n") > MORE).select("key", "id").join(reps.select("id", "n"), "id")
    size = F.floor(F.ln("n") / F.lit(float(np.log(100 / PERCENT))) + 1e-9)
    parted = many.select("id", "key", F.explode(F.array(size, size + 1)).alias("size"))
    return few.unionByName(parted.select(F.xxhash64("key", "size").alias("key"), "id"))


def _sides(rows: DataFrame, group: str, less: int, more: int) -> DataFrame:
    """Rows of groups with more than one label, dealt into blocks (group, i, j): those outside the group's largest label against all."""
    parts = rows.groupBy(group, "label").agg(F.count("*").alias("n_label"))
    mixed = parts.groupBy(group).agg(F.max(F.struct("n_label", "label")).alias("most"), F.sum("n_label").alias("m")).where("most.n_label < m")
    mixed = kept(mixed.select(group, F.col("most.label").alias("most"), "m", (F.col("m") - F.col("most.n_label")).alias("k")), "nd-mixed")
    open_ = rows.join(mixed, group)
    columns = [c for c in rows.columns if c != group]
    few = open_.where("label <> most").select(group, blocks.block(F.col("id"), F.col("k"), less).alias("i"), blocks.all_blocks(F.col("m"), more).alias("j"), F.lit(True).alias("less"), *columns)
    all_ = open_.select(group, blocks.all_blocks(F.col("k"), less).alias("i"), blocks.block(F.col("id"), F.col("m"), more).alias("j"), F.lit(False).alias("less"), *columns)
    return few.union(all_)


def classes(docs: DataFrame, row: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(sketches, classes, links or None): a row per document with its set's size and name, a row per distinct set, and the confirmed links between these.

    docs has doc_id and text; ``row`` is carried along with each document. A
    class has a number of its own, so ids may repeat or be null; its
    representative is the document of least doc_id. Documents without words have
    no class.
    """
    small_batches(docs.sparkSession)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    mine = F.struct(F.col("doc_id"), _text_key().alias("text_key"), (F.lit(None).cast("struct<a:bigint,b:bigint>") if row is None else row).alias("own"))
    told = docs.select(mine.alias("row"), "text")
    sketches = kept(told.mapInArrow(_sketch, f"row {told.schema['row'].dataType.simpleString()}, n bigint, lo bigint, hi bigint, bands binary, sig binary").select("row.*", "n", "lo", "hi", "bands", "sig"), "nd-sketch")
    # numbered in the written table, so that a number stays what it is
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("rep")
    reps = kept(sketches.where("n > 0").groupBy("lo", "hi").agg(first, F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig"), F.any_value("n").alias("n")).withColumn("id", F.monotonically_increasing_id()), "nd-classes")
    buckets = reps.select("id", "bands").mapInArrow(_keys, "key bigint, id bigint")
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    live = kept(buckets.join(shared, "key").select("key", "id", "n"), "nd-buckets")
    fame = kept(live.groupBy("id").agg(F.sum("n").alias("fame")), "nd-fame")
    if fame.isEmpty():
        return sketches, reps, None
    live = kept(live.join(fame, "id").select("key", "id", "n", "fame"), "nd-live")
    # the member that shares most buckets is the same in nearly all buckets of a group, so stars repeat few pairs
    # written first: a join above an aggregate of the same exchange couldn't split a large bucket
    centre = kept(live.groupBy("key").agg(F.max(F.struct("fame", (-F.col("id")).alias("minus"))).alias("c")).select("key", (-F.col("c.minus")).alias("centre")), "nd-centres")
    rest = kept(live.join(centre, "key").where("id <> centre"), "nd-rest")
    tried = kept(_pairs_once(rest), "nd-star")
    links = kept(_confirmed(tried, reps, docs), "nd-links")
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    labels = kept(components(links).withColumnRenamed("component", "label"), "nd-labels")
    marked = _by_size(rest.select("key", "id", "n"), reps).join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    sides = _sides(marked, "key", LESS, MORE).join(reps.select("id", "n", "sig"), "id").select("key", "i", "j", "less", "id", "label", "n", "sig")
    likely = kept(blocks.together(sides, ["key", "i", "j"], n_parts).mapInArrow(_likely, "a bigint, b bigint").distinct(), "nd-likely")
    if likely.isEmpty():
        return sketches, reps, links
    family = components(likely.union(links)).withColumnRenamed("component", "family")
    members = family.join(labels, "id", "left").select("family", "id", F.coalesce("label", "id").alias("label"))
    sides = kept(_sides(members, "family", LESS_SETS, MORE_SETS), "nd-family")
    sets = _full_sets(sides.select("id").distinct(), reps, docs)
    met = blocks.together(sides.join(sets, "id").select("family", "i", "j", "less", "id", "label", "hashes"), ["family", "i", "j"], n_parts)
    return sketches, reps, kept(links.union(met.mapInArrow(_met, "a bigint, b bigint")), "nd-links")


def _edges(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What joins the documents as the pairs (i, j) do: each with the least of its component, so that blocks repeat few edges."""
    if len(i):
        order = np.argsort(ids)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        v, root = blocks.forest(len(ids), rank[i], rank[j])
        a, b = ids[order][v], ids[order][root]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the documents of one block with those of another that have another label and whose signatures and sizes leave a link possible."""
    for run in blocks.runs(batches, 3):
        less = run.column("less").to_numpy(zero_copy_only=False).astype(bool)
        if not less.any() or less.all():
            continue
        ids, labels, sizes = (run.column(c).to_numpy() for c in ("id", "label", "n"))
        sig = blocks.matrix(run.column("sig"), "u1")
        same = (sig[less][:, None, :] == sig[~less][None, :, :]).mean(axis=2)
        na, nb = sizes[less][:, None], sizes[~less][None, :]
        least = np.minimum(na, nb)
        limit = PERCENT / 100
        may = (100 * least >= PERCENT * np.maximum(na, nb)) & (labels[less][:, None] != labels[~less][None, :]) & (same >= limit - DEVIATIONS * np.sqrt(limit * (1 - limit) / np.minimum(least, BINS)))
        i, j = np.nonzero(may)
        yield from _edges(ids, np.flatnonzero(less)[i], np.flatnonzero(~less)[j])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the documents of one block with those of another that are linked, by the full sets."""
    for run in blocks.runs(batches, 3):
        less = run.column("less").to_numpy(zero_copy_only=False).astype(bool)
        if not less.any() or less.all():
            continue
        ids, labels = run.column("id").to_numpy(), run.column("label").to_numpy()
        sets = run.column("hashes").combine_chunks()
        flat, sizes = sets.flatten().to_numpy(), np.asarray(sets.value_lengths())
        row = np.repeat(np.arange(len(ids)), sizes)
        shared = np.intersect1d(flat[less[row]], flat[~less[row]])
        use = np.isin(flat, shared)
        at, row = np.searchsorted(shared, flat[use]), row[use]
        place = np.cumsum(less) - 1, np.cumsum(~less) - 1
        common = np.zeros((int(less.sum()), int((~less).sum())), dtype=np.float32)
        for a in range(0, len(shared), 8192):  # bounded memory, however many shingles are shared
            part = (at >= a) & (at < a + 8192)
            left, right = part & less[row], part & ~less[row]
            x = np.zeros((common.shape[0], 8192), dtype=np.float32)
            y = np.zeros((common.shape[1], 8192), dtype=np.float32)
            x[place[0][row[left]], at[left] - a] = 1
            y[place[1][row[right]], at[right] - a] = 1
            common += x @ y.T
        total = sizes[less][:, None] + sizes[~less][None, :]
        linked = (100 * common.astype(np.int64) >= PERCENT * (total - common.astype(np.int64))) & (labels[less][:, None] != labels[~less][None, :])
        i, j = np.nonzero(linked)
        yield from _edges(ids, np.flatnonzero(less)[i], np.flatnonzero(~less)[j])


def _ordered(star: DataFrame) -> DataFrame:
    return star.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"))


def _pairs_once(star: DataFrame) -> DataFrame:
    """(id, centre), each pair once though two members may be centres for each other."""
    a, b = F.least("id", "centre"), F.greatest("id", "centre")
    once = star.groupBy(a.alias("a"), b.alias("b")).agg(F.min("centre").alias("centre"))
    return once.select(F.when(F.col("a") == F.col("centre"), F.col("b")).otherwise(F.col("a")).alias("id"), "centre")


def _groups(reps: DataFrame, links: DataFrame | None) -> DataFrame:
    """(lo, hi, component): the number of a class that its whole group of classes shares."""
    if links is None:
        return reps.select("lo", "hi", F.col("id").alias("component"))
    return kept(reps.select("lo", "hi", "id").join(components(links), "id", "left").select("lo", "hi", F.coalesce("component", "id").alias("component")), "nd-reps")


def _ids_unpacked(run):
    @functools.wraps(run)
    def within(docs: DataFrame) -> DataFrame:
        with sizes_unpacked(docs.sparkSession):
            return run(docs)

    return within


@_ids_unpacked
def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are ignored): doc_id, n_shingles, component_id, kept.

    component_id is the least doc_id that links reach; documents without words
    (empty or null texts) have 0 shingles and are linked with nothing. A doc_id
    may repeat: every row is looked at by its own text. Documents without a
    doc_id take part, but name a group only if none of it has one; then
    component_id is null. Long texts are read whole, rows that are alike are
    linked, and an empty table gives an empty result.
    """
    sketches, reps, links = classes(docs)
    groups = _groups(reps, links)
    least = groups.join(reps.select("lo", "hi", F.col("rep.doc_id").alias("least")), ["lo", "hi"])
    named = kept(least.join(least.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("lo", "hi", "component_id", F.lit(True).alias("grouped")), "nd-names")
    done = sketches.select("doc_id", F.col("n").alias("n_shingles"), "lo", "hi", (F.col("n") > 0).alias("has")).join(named, ["lo", "hi"], "left")
    done = done.select("doc_id", "n_shingles", F.when(F.col("has") & F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return done.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _row_names(docs: DataFrame) -> Column:
    """128 bits that name a row by all of its columns."""
    plain = lambda f: "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()
    columns = [F.col(f"`{f.name}`") if plain(f) else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in docs.schema]
    # a null isn't hashed: whether a column is null is hashed beside it
    columns += [c.isNull() for c in columns]
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(23), *columns).alias("b"))


@_ids_unpacked
def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each group of linked rows the one of least doc_id, of equals any one. Columns and their names are as in docs.

    Decided row by row: two texts under one doc_id are two documents, rows
    without a doc_id come last, and rows without words all stay. A row that is
    alike in every column with others is one document, and stays once.
    """
    name = _row_names(docs)
    sketches, reps, links = classes(docs.select(F.col("doc_id"), F.col("text"), name.alias("own_name")), F.col("own_name"))
    grouped = sketches.where("n > 0").select("lo", "hi", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "own").alias("me")).join(_groups(reps, links), ["lo", "hi"])
    grouped = kept(grouped.groupBy("component", "me").agg(F.count("*").alias("alike")), "nd-rows")
    best = kept(grouped.groupBy("component").agg(F.min("me").alias("best"), F.count("*").alias("others"), F.sum("alike").alias("rows")).where("rows > 1"), "nd-best")
    rest = grouped.join(best, "component")
    gone = kept(rest.where("me <> best").select("me.own.a", "me.own.b").distinct(), "nd-gone")
    again = kept(rest.where("me = best AND alike > 1").select("me.own.a", "me.own.b").distinct(), "nd-again")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), name.a.alias("a"), name.b.alias("b"))
    rows = _without(rows, gone, ["a", "b"])
    if not again.isEmpty():
        once = _without(rows, again, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.first("row").alias("row")).select("row", "a", "b")
        rows = _without(rows, again, ["a", "b"]).unionByName(once)
    return rows.select("row.*")
