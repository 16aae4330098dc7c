"""Near-duplicates by DartMinHash signatures and banded joining.

A text is the multiset of its five-word shingles; the weight of a shingle is
how often it occurs, and similarity is weighted Jaccard. The region of an
element, from 0 to its weight, is covered by strips that double in width;
hashed darts hit them at exponential arrival times, and those beyond the
weight don't count. Each of ``k`` coordinates keeps the earliest dart that
hits it. Work is in proportion to the different shingles, the logarithms of
their weights and the darts. Texts that agree in a whole band of coordinates
are compared by exact similarity, in two rounds:

1. Every member of a band is compared with one lead: the smallest member of
   the bands that it is in most often. Links become classes.
2. In bands that still hold several classes, every member outside the band's
   largest class is compared with all members of other classes.

Comparisons are made in cells of bounded size: a band's texts are dealt to
blocks, and a cell is a block of outsiders with a block of members. A cell
sends back which classes are linked, never pairs, so that copies by the
thousand cost rows in proportion to their number. Round 2 is exhaustive within a
band: its comparisons (not its rows) grow with outsiders times members.

Equal texts are one node from the start, so a group of copies costs one
comparison. Nodes are 64-bit hashes of texts (about 25 false merges are
expected among 3 * 10**10 different texts). Null texts are classes of their
own; empty texts, and texts of fewer than five words, are classed with equal
texts only. Rows with a null id take part and are returned; a class is named by its smallest
id that isn't null. Repeated rows share a class. An empty table gives an empty
result. Very long texts have all their shingles counted. Other columns aren't
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._tables import cut, small_batches
from quillspark.llm._words import Words, gram_hashes, mix64, released, slices

SHINGLE = 5
ROWS, BANDS = 6, 32
THRESHOLD = 0.8
#: Texts and words of a block, at most on average; a single text is never split.
BLOCK_TEXTS, BLOCK_WORDS = 1024, 300_000
#: Texts that throw their darts at once.
TEXTS_AT_ONCE = 512
#: Elements that are in more texts of a cell than this are counted by a matrix product, so many at a time.
FREQUENT, COLUMNS = 32, 2048


def shingle_weights(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count) of the different shingles of each text, in order of text and hash."""
    grams, at = gram_hashes(words.hashes(), words.left(), SHINGLE)
    doc = words.doc[at]
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.concatenate(([True], (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    return doc[begin], grams[begin], np.diff(np.append(begin, len(doc)))


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def strips(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, number, lower end) of the strips [0, 1), [1, 2), [2, 4), [4, 8) ... that begin below each weight."""
    n = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))), 0).astype(np.int64) + 1
    element = np.repeat(np.arange(len(weight)), n)
    number = np.arange(len(element)) - np.repeat(np.cumsum(n) - n, n)
    return element, number, np.where(number > 0, 2.0 ** (number - 1), 0.0)


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, k: int) -> np.ndarray:
    """The earliest dart of each coordinate, rows x k; rows without elements are all zero.

    A strip has a Poisson process of darts whose rate is its width: gaps are
    exponential; place, coordinate and identity come from the dart's hash. A
    dart counts for an element whose weight lies above its place. All darts up
    to time t = (k ln k + 2k) / weight are thrown, and up to twice that for
    texts with a coordinate not yet hit, and so on.
    """
    best_time = np.full(rows * k, np.inf)
    best = np.zeros(rows * k, np.uint64)
    if not len(doc):
        return best.reshape(rows, k)
    total = np.bincount(doc, weight, rows)
    of, number, low = strips(weight)
    strip = np.arange(len(of))
    strip_doc, width, over = doc[of], np.maximum(low, 1.0), weight[of] - low
    inner = over >= width
    with np.errstate(over="ignore"):
        dart = mix64(element[of] + mix64(number.astype(np.uint64)))
    time = -np.log(uniform(dart)) / width
    until = (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300)
    while len(dart):
        waiting = []
        while len(dart):
            now = time <= until[strip_doc[strip]]
            if not now.all():
                waiting.append((strip[~now], dart[~now], time[~now]))
            strip, dart, time = strip[now], dart[now], time[now]
            if not len(dart):
                break
            hit = mix64(dart ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            at = strip_doc[strip] * k + (hit % np.uint64(k)).astype(np.int64)
            better = time < best_time[at]
            cut_off = np.flatnonzero(better & ~inner[strip])
            if len(cut_off):
                s = strip[cut_off]
                better[cut_off] = uniform(mix64(hit[cut_off])) * width[s] <= over[s]
            better = np.flatnonzero(better)
            better = better[np.argsort(-time[better], kind="stable")]
            best_time[at[better]], best[at[better]] = time[better], hit[better]  # of equal places the last, so the earliest, stays
            with np.errstate(over="ignore"):
                dart = mix64(dart + np.uint64(0x632BE59BD9B4E019))
            time = time - np.log(uniform(dart)) / width[strip]
        short = np.isinf(best_time.reshape(rows, k)).any(1) & (total > 0)
        if not short.any() or not waiting:
            break
        until[short] *= 2
        strip, dart, time = (np.concatenate(x) for x in zip(*waiting, strict=True))
        more = short[strip_doc[strip]]
        strip, dart, time = strip[more], dart[more], time[more]
    return best.reshape(rows, k)


def band_keys(signatures: np.ndarray, rows: int, bands: int) -> np.ndarray:
    keys = np.zeros((len(signatures), bands), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            keys = mix64(keys * np.uint64(31) + signatures.reshape(len(signatures), bands, rows)[:, :, r])
        return mix64(keys + np.arange(bands, dtype=np.uint64)).view(np.int64)


def overlaps(doc: np.ndarray, gram: np.ndarray, weight: np.ndarray, rows: int, lead: np.ndarray) -> np.ndarray:
    """Sums of smaller weights of the shingles that texts share: a row for each text of ``lead``, a column for every text
    (what a text shares with itself is not counted in full).

    A shingle of weight w is w elements, so that what texts share is a count.
    Elements of few texts are counted by their pairs, those of many by products
    of 0/1 matrices.
    """
    out = np.zeros((len(lead), rows), np.float32)
    place = np.full(rows, -1)
    place[lead] = np.arange(len(lead))
    level = (np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)).astype(np.uint64)
    doc, gram = np.repeat(doc, weight), np.repeat(gram, weight)
    gram = np.where(level > 0, mix64(gram ^ mix64(level)), gram)
    order = np.argsort(gram, kind="stable")
    doc, gram = doc[order], gram[order]
    begin = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, np.int64)
    n = np.diff(np.append(begin, len(gram)))
    element = np.repeat(np.arange(len(n)), n)
    rare = np.flatnonzero((place[doc] >= 0) & (n[element] > 1) & (n[element] <= FREQUENT))
    for low in range(0, len(rare), 1 << 14):
        some = rare[low : low + (1 << 14)]
        many = n[element[some]]
        other = np.repeat(begin[element[some]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out += np.bincount(np.repeat(place[doc[some]], many) * rows + doc[other], minlength=out.size).reshape(out.shape).astype(np.float32)
    often = np.flatnonzero(n > FREQUENT)
    for low in range(0, len(often), COLUMNS):
        some = often[low : low + COLUMNS]
        grid = np.zeros((rows, len(some)), np.float32)
        column = np.repeat(np.arange(len(some)), n[some])
        at = np.repeat(begin[some], n[some]) + np.arange(len(column)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
        grid[doc[at], column] = 1
        out += grid[lead] @ grid.T
    return out


def smallest_linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of 0 .. n - 1 that links (a, b) lead to from each."""
    name = np.arange(n)
    while True:
        before = name.copy()
        low = np.minimum(name[a], name[b])
        for side in (a, b):
            np.minimum.at(name, name[side], low)
        name = name[name]
        if (name == before).all():
            return name


def linked_classes(cell: pa.Table, threshold: float) -> pa.Table:
    """(a, b): classes of a cell that links of its leads join, and the smallest class that each is joined to."""
    cell = cell.combine_chunks()
    words = Words(cell["text"].chunk(0) if cell.num_rows else pa.array([], pa.string()))
    doc, gram, weight = shingle_weights(words)
    total = np.bincount(doc, weight, cell.num_rows)
    label, cls = np.unique(cell["class"].to_numpy(), return_inverse=True)
    lead = np.flatnonzero(cell["is_lead"].to_numpy(zero_copy_only=False))
    shared = overlaps(doc, gram, weight, cell.num_rows, lead).astype(np.float64)
    near = (shared > 0) & (shared >= (threshold - 1e-12) * (total[lead][:, None] + total[None, :] - shared)) & (cls[lead][:, None] != cls[None, :])
    row, column = np.nonzero(near)
    joined = smallest_linked(cls[lead[row]], cls[column], len(label))
    moved = np.flatnonzero(joined != np.arange(len(label)))
    return pa.table({"a": pa.array(label[moved], pa.int64()), "b": pa.array(label[joined[moved]], pa.int64())})


def band_rows(docs: DataFrame, rows: int, bands: int) -> DataFrame:
    """(node, words, bands) for every text with shingles; a task leaves out texts that it has just seen."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch, "text", most_rows=TEXTS_AT_ONCE):
                node = part.column(0).to_numpy()
                use = np.zeros(len(node), bool)
                use[np.unique(node, return_index=True)[1]] = True
                use &= words.counts >= SHINGLE
                keys = band_keys(dart_signatures(*shingle_weights(words), part.num_rows, rows * bands), rows, bands)[use]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(node[use]), pa.array(words.counts[use].astype(np.int64)), lists], names=["node", "words", "bands"])

    return docs.select("node", "text").mapInArrow(released(make), "node long, words long, bands array<long>")


def is_star_forest(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(False).alias("into")).union(edges.select("v", F.lit(0), F.lit(True)))
    at = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not at.agg(F.coalesce(F.max((F.col("out") > 1) | ((F.col("out") > 0) & F.col("into"))), F.lit(False))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """(node, class): the smallest node that links (a, b) lead to, for every node with a link other than that one.

    Each round hangs every node's larger neighbours under its smallest one
    (large star), then its smaller ones (small star), until all are stars.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while not is_star_forest(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # cut, so that the join has exchanges of its own and a large star can be split
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        edges = cut(small.filter("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("class"))


def n_blocks(texts, words, block: tuple[int, int]):
    """Blocks that so many texts and words are dealt to."""
    return F.greatest(F.ceil(texts / block[0]), F.ceil(words / block[1])).cast("int")


def link_cells(cells: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): linked classes of all cells; rows of a cell have the columns group, i, j, node, class, is_lead."""
    rows = cells.join(texts, "node").select("group", "i", "j", "class", "is_lead", "text")
    return rows.groupBy("group", "i", "j").applyInArrow(lambda t: linked_classes(t, threshold), "a long, b long").distinct()


def first_cells(members: DataFrame, block: tuple[int, int]) -> DataFrame:
    """Round 1: the nodes that have the same lead, dealt to blocks; the lead is in each."""
    with_lead = members.filter("lead IS NOT NULL").select(F.col("lead").alias("group"), "node", "words")
    groups = cut(with_lead.groupBy("group").agg(n_blocks(F.count(F.lit(1)), F.sum("words"), block).alias("n")))
    own = with_lead.join(groups, "group").select("group", F.pmod(F.xxhash64("node"), "n").cast("int").alias("j"), "node", F.lit(False).alias("is_lead"))
    leads = groups.select("group", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"), F.col("group").alias("node"), F.lit(True).alias("is_lead"))
    return own.union(leads).select("group", F.lit(0).alias("i"), "j", "node", F.col("node").alias("class"), "is_lead")


def open_cells(members: DataFrame, classes: DataFrame, block: tuple[int, int]) -> DataFrame:
    """Round 2: cells of the bands that hold several classes."""
    rows = members.join(classes, "node", "left").select("node", F.coalesce("class", "node").alias("class"), "words", "lead", F.explode("bands").alias("b"))
    rows = cut(rows.select(F.col("b.band").alias("group"), "node", "class", "words", ((F.col("b.size") == 2) & (F.col("lead") == F.col("b.low"))).alias("is_done")))
    per_class = rows.groupBy("group", "class").agg(
        F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"), F.max("is_done").alias("is_done"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("xor")
    )
    per_band = per_class.groupBy("group").agg(
        F.max_by(F.struct("class", "n", "words"), F.struct("n", F.bitwise_not(F.col("class")))).alias("top"),
        F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n"), F.sum("words").alias("words"), F.max("is_done").alias("is_done"), F.sum("sum").alias("sum"), F.bit_xor("xor").alias("xor"),
    )
    # bands of the same members are one: two 64-bit sums of hashes and the count tell
    still = per_band.filter("classes > 1 AND NOT is_done").groupBy("n", "sum", "xor").agg(F.min_by(F.struct("group", "top", "words"), "group").alias("g"))
    still = cut(
        still.select(
            F.col("g.group").alias("group"), F.col("g.top.class").alias("top"), n_blocks(F.col("n"), F.col("g.words"), block).alias("n"),
            n_blocks(F.col("n") - F.col("g.top.n"), F.col("g.words") - F.col("g.top.words"), block).alias("n_out"),
        )
    )
    found = rows.join(still, "group").withColumns({"is_lead": F.col("class") != F.col("top"), "i": F.pmod(F.xxhash64("node"), "n_out"), "j": F.pmod(F.xxhash64("node"), "n")})
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    as_member = F.transform(every("n_out"), lambda i: cell(i, F.col("j")))
    as_lead = F.when(F.col("is_lead"), F.transform(every("n"), lambda j: cell(F.col("i"), j))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    found = found.withColumn("cell", F.explode(F.array_union(as_member, as_lead)))
    return found.select("group", "cell.i", "cell.j", "node", "class", "is_lead")


def node_classes(docs: DataFrame, threshold: float, rows: int, bands: int, block: tuple[int, int]) -> DataFrame:
    """(node, class) of the nodes of ``docs`` (node, text) that have links, other than those that name a class."""
    banded = cut(band_rows(docs, rows, bands).dropDuplicates(["node"]))
    spread = banded.select(F.explode("bands").alias("band"), "node", "words")
    shared = cut(spread.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("size")).filter("low < high"))
    joined = spread.join(shared, "band")
    members = cut(
        joined.groupBy("node").agg(
            F.first("words").alias("words"),
            F.mode(F.when(F.col("low") != F.col("node"), F.col("low")), True).alias("lead"),
            F.collect_list(F.struct("band", "low", "size")).alias("bands"),
        )
    )
    texts = cut(docs.join(members.select("node"), "node").dropDuplicates(["node"]))
    first = components(link_cells(first_cells(members, block), texts, threshold))
    merged = components(link_cells(open_cells(members, first, block), texts, threshold))
    renamed = merged.select(F.col("node").alias("class"), F.col("class").alias("name"))
    return cut(first.join(renamed, "class", "left").select("node", F.coalesce("name", "class").alias("class")).union(merged))


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, rows: int = ROWS, bands: int = BANDS, block: tuple[int, int] = (BLOCK_TEXTS, BLOCK_WORDS), id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, node, class, class_id, is_kept): the class of each row, named by its smallest id; is_kept marks the row (or
    the rows equal to it) that stands for the class."""
    small_batches(docs.sparkSession)
    light = docs.select(F.col(id_column).alias(id_column), F.xxhash64(text_column).alias("node"), F.col(text_column).isNull().alias("is_null"))
    texts = docs.filter(F.col(text_column).isNotNull()).select(F.xxhash64(text_column).alias("node"), F.col(text_column).alias("text"))
    classes = node_classes(texts, threshold, rows, bands, block)
    # one row a node first, so that a group of copies is summed up before it is shuffled
    per_node = light.filter("NOT is_null").groupBy("node").agg(F.min(F.struct(F.col(id_column).isNull().alias("no_id"), F.col(id_column).alias("id"))).alias("first"))
    named = cut(per_node.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node")))
    best = named.groupBy("class").agg(F.min(F.struct("first", "node")).alias("best"))
    # cut, so that the joins have exchanges of their own and a large class or node can be split
    placed = cut(named.join(cut(best), "class").select("node", "class", "best"))
    joined = light.join(placed.withColumn("is_null", F.lit(False)), ["node", "is_null"], "left")
    kept = F.col("is_null") | ((F.col("best.node") == F.col("node")) & F.col("best.first.id").eqNullSafe(F.col(id_column)))
    name = F.when(F.col("is_null"), F.col(id_column)).otherwise(F.col("best.first.id"))
    return joined.select(id_column, "node", F.coalesce("class", "node").alias("class"), name.alias("class_id"), kept.alias("is_kept"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their classes, one for each; rows of null text all stay."""
    found = near_duplicates(docs, threshold, id_column=id_column, text_column=text_column).filter("is_kept")
    kept = cut(found.groupBy(F.col(id_column).alias("kept_id"), F.col("node").alias("kept_node")).agg(F.count(F.lit(1)).alias("times")))
    match = lambda k: F.col(id_column).eqNullSafe(k["kept_id"]) & (F.xxhash64(text_column) == k["kept_node"])
    again = kept.filter("times > 1")
    if again.isEmpty():
        return docs.join(kept, match(kept), "left_semi")
    # rows repeated as a whole: one of each, but all of null text
    once, repeated = kept.filter("times = 1"), docs.join(again, match(again), "left_semi")
    return docs.join(once, match(once), "left_semi").unionByName(repeated.filter(F.col(text_column).isNull())).unionByName(
        repeated.filter(F.col(text_column).isNotNull()).dropDuplicates([id_column, text_column])
    )
