"""MinHash near-duplicates: one-permutation hashing with optimal densification, bands, and star-shaped edges.

Documents of equal shingle sets are one class.  Classes that share a band are compared with the band's centre
first, on full sets; a band whose members then still lie in different components gets another centre in the next
round.  So a band of m classes costs at most m comparisons a round, and copies none.  What bands still hold in
different components after these rounds is compared in full, block by block: every two classes that share a band
and may be alike are compared or already linked.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, mix, pieces, ship, space_rule, text_buffers, word_hashes, written

ship(__name__)

SHINGLE = 3
PERCENT = 85
#: Bins of a band, and the chance at most that two sets of the least similarity share no band.
ROWS, MISS = 4, 2e-6
#: Rounds of centres, for cheap links; the rest is compared in full.
ROUNDS = 3
#: Members that one task compares with a centre; centres of more are sent to several tasks.
STAR = 500
#: A band of up to so many classes is finished pair by pair, a larger one by blocks.
FEW = 8
#: Most classes and about most shingles of a block; a task compares two blocks.
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
#: Bits of the table that marks wanted ids: 4 MB at any size of the input.
MARKS = 1 << 25


def shingle_sets(column, shingle: int = SHINGLE) -> list:
    """Per text of an Arrow string array the sorted 64-bit hashes of its distinct shingles; whole texts."""
    data, offsets = text_buffers(column)
    words, at = word_hashes(data, offsets, space_rule())
    out = []
    for i in range(len(offsets) - 1):
        h = words[at[i]:at[i + 1]]
        if len(h) > shingle:
            n = len(h) - shingle + 1
            s = np.zeros(n, np.uint64)
            for k in range(shingle):
                s = mix(s + h[k:k + n])
        elif len(h):
            s = np.zeros(1, np.uint64)
            for x in h:
                s = mix(s + x)
        else:
            s = h
        out.append(np.unique(s))
    return out


def bands_for(percent: int = PERCENT) -> int:
    """Bands of ROWS bins that leave a pair of similarity ``percent`` without a common band with a chance of MISS at most: 18 for 85, 25 for 80."""
    share = (percent / 100) ** ROWS
    return int(np.ceil(np.log(MISS) / np.log1p(-share))) if share < 1 else 1


def densification(percent: int = PERCENT):
    """For each bin the order in which it asks the others when it is empty: a fixed random order of its own."""
    rng, bins = np.random.default_rng(5), bands_for(percent) * ROWS
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def signature(s, ask) -> np.ndarray:
    """The least hash of each of len(ask) equal ranges; an empty bin takes that of the first filled bin it asks."""
    width = np.uint64((1 << 64) // len(ask))
    edges = np.arange(len(ask), dtype=np.uint64) * width
    at = np.searchsorted(s, edges)
    until = np.append(at[1:], len(s))
    filled = at < until
    low = np.where(filled, s[np.minimum(at, len(s) - 1)], np.uint64(0))
    empty = np.flatnonzero(~filled)
    if len(empty):
        asked = filled[ask[empty]]
        low[empty] = low[ask[empty, asked.argmax(axis=1)]]
    return low


def band_keys(low) -> np.ndarray:
    """One 64-bit key per band, of the band's number and its bins."""
    rows = low.reshape(-1, ROWS)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key + rows[:, k])
    return key.view(np.int64)


def class_key(s) -> bytes:
    """128-bit name of a shingle set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, doc_id: str, text: str, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (class; null without a word), bands: map-only, written once."""
    def run(batches):
        import pyarrow as pa
        ask = densification(percent)
        for b in pieces(batches, 1):
            sets = shingle_sets(b.column(1), shingle)
            bands = [band_keys(signature(s, ask)) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_key(s) if len(s) else None for s in sets], pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n_shingles", "node", "bands"])
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    return written(rows.mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, node binary, bands array<long>"), "signatures")


def likely(rows: DataFrame, key: str, wanted: DataFrame, by: str, marks: int = MARKS) -> DataFrame:
    """The rows whose ``key`` is in ``wanted`` (``by``), null too, and a few others, where they stand: only they have to be dealt out.

    Hashes of wanted keys set bits of a table of fixed size, which is broadcast.  Keys that share a bit pass as well, so
    the exact join has to follow.
    """
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(marks))
    table = wanted.select(F.bitmap_bucket_number(spot(by)).alias("_bucket"), F.bitmap_bit_position(spot(by)).alias("_bit"))
    table = table.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    place = F.bitmap_bit_position(spot(key))
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    met = (F.bitmap_bucket_number(spot(key)) == F.col("_bucket")) & (F.getbit(byte, (place % 8).cast("int")) == 1)
    return rows.join(F.broadcast(table), met, "left_semi")


def sets_of(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """node, hashes (its full set) for the classes in ``wanted`` (node, rep): from one document of each, written once.

    Another row of the same id may hold another text, or the same one again; neither is taken.
    """
    def run(batches):
        import pyarrow as pa
        last = None
        for b in pieces(batches, 1):
            sets, ok = shingle_sets(b.column(1), shingle), []
            for s, n in zip(sets, b.column(0).to_pylist()):
                ok.append(n != last and class_key(s) == n)
                last = n if ok[-1] else last
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok, pa.bool_())),
                                              pa.array([s.tobytes() for s, x in zip(sets, ok) if x], pa.binary())], ["node", "hashes"])
    rows = likely(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")), "_id", wanted, "rep")
    j = rows.join(wanted, F.col("_id").eqNullSafe(F.col("rep")))
    return written(j.select("node", "text").mapInArrow(run, "node binary, hashes binary"), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The (centre, member) pairs whose full sets are alike: 100 * common >= percent * union.

    The centre's set is sent once to each of the tasks that hold up to STAR of its members, and met there first.
    """
    sized = pairs.groupBy("centre").agg(F.count(F.lit(1)).alias("k")).withColumn("parts", F.ceil(F.col("k") / STAR).cast("int"))
    members = (pairs.join(sized, "centre").select("centre", (F.pmod(F.xxhash64("member"), F.col("parts"))).cast("int").alias("part"), F.col("member").alias("node")))
    heads = sized.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("centre").alias("node"))
    rows = members.withColumn("role", F.lit(1)).unionByName(heads.withColumn("role", F.lit(0))).join(sets, "node")
    rows = rows.repartition("centre", "part").sortWithinPartitions("centre", "part", "role")

    def run(batches):
        import pyarrow as pa
        now, head = None, None
        for b in batches:
            out = []
            for c, part, role, node, blob in zip(*[b.column(n) for n in ("centre", "part", "role", "node", "hashes")]):
                key = (c.as_py(), part.as_py())
                mine = np.frombuffer(blob.as_buffer(), np.uint64)
                if role.as_py() == 0:
                    now, head = key, mine.copy()
                elif now == key:
                    common = len(head) + len(mine) - len(np.union1d(head, mine))
                    if 100 * common >= percent * (len(head) + len(mine) - common):
                        out.append((key[0], node.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], ["a", "b"])
    return written(rows.select("centre", "part", "role", "node", "hashes").mapInArrow(run, "a binary, b binary"), "links")


def remaining(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows (node, n, band) of bands that hold several components, with label and k (rows of the band)."""
    if labels is None:
        member = rows.withColumn("label", F.col("node"))
    else:
        member = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    member = written(member, "members")
    several = member.groupBy("band").agg(F.count(F.lit(1)).alias("k"), F.min("label").alias("_a"), F.max("label").alias("_b"))
    return written(member.join(several.filter("_a != _b").select("band", "k"), "band"), "remaining")


def few_pairs(rest: DataFrame, tried: DataFrame | None, percent: int = PERCENT) -> DataFrame:
    """(centre, member): all pairs of different components in bands of up to FEW classes that may be alike and are not in ``tried``."""
    x, y = (rest.filter(F.col("k") <= FEW).select("band", *[F.col(c).alias(f"{s}_{c}") for c in ("node", "n", "label")]) for s in "xy")
    j = x.join(y, "band").filter((F.col("x_node") < F.col("y_node")) & (F.col("x_label") != F.col("y_label"))
                                 & (F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent))
    pairs = j.select(F.col("x_node").alias("centre"), F.col("y_node").alias("member")).distinct()
    if tried is not None:
        back = tried.select(F.col("member").alias("centre"), F.col("centre").alias("member"))
        pairs = pairs.join(tried.unionByName(back), ["centre", "member"], "left_anti")
    return written(pairs, "pairs")


def alike(a: list, b: list, percent: int) -> np.ndarray:
    """Of each set in ``a`` with each in ``b``: 100 * common >= percent * union, counted exactly."""
    sizes = [np.array([len(s) for s in side]) for side in (a, b)]
    found, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    cut = int(sizes[0].sum())
    met = np.zeros(len(found), bool)
    met[at[:cut]] = True
    both = np.zeros(len(found), bool)
    both[at[cut:]] = True
    both &= met
    place = np.cumsum(both) - 1
    cells = []
    for n, part in zip(sizes, (at[:cut], at[cut:])):
        row, ok = np.repeat(np.arange(len(n)), n), both[part]
        row, col = row[ok], place[part[ok]]
        order = np.argsort(col, kind="stable")
        cells.append((row[order], col[order]))
    common, step = np.zeros((len(a), len(b)), np.int64), 4096
    for lo in range(0, int(both.sum()), step):
        dense = []
        for (row, col), n in zip(cells, sizes):
            i, j = np.searchsorted(col, (lo, lo + step))
            m = np.zeros((len(n), step), np.float32)
            m[row[i:j], col[i:j] - lo] = 1
            dense.append(m)
        common += (dense[0] @ dense[1].T).astype(np.int64)  # at most 4096 in a cell: exact
    return 100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common)


def joining(ok: np.ndarray, a: list, b: list):
    """Of the pairs (i, j) that ``ok`` marks, those that join different labels ``a[i]`` and ``b[j]`` not yet joined by earlier ones."""
    up = {}

    def root(x):
        while up.get(x, x) != x:
            up[x] = x = up.get(up[x], up[x])
        return x
    for i, j in zip(*np.nonzero(ok)):
        x, y = root(a[i]), root(b[j])
        if x != y:
            up[x] = y
            yield int(i), int(j)


def block_links(rest: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between the components of each band of more than FEW classes: all its pairs of different components
    that may be alike are compared on full sets, two blocks in a task.

    Blocks hold classes of like size, of the band's largest component or of the others; the largest is not compared with
    itself.  Sizes of a similar pair lie in the same or in neighbouring steps.
    """
    many = rest.filter(F.col("k") > FEW)
    per = many.groupBy("band", "label").agg(F.count(F.lit(1)).alias("c"))
    largest = per.groupBy("band").agg(F.max(F.struct("c", "label")).alias("_l")).select("band", F.col("_l.label").alias("_main"))
    step = float(np.log(100 / percent)) * 1.0001 if percent < 100 else 1e-9
    many = many.join(largest, "band").withColumn("main", F.col("label") == F.col("_main")).withColumn("step", F.floor(F.log("n") / F.lit(step)))
    units = many.groupBy("band", "step", "main").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("most"))
    units = units.withColumn("parts", F.ceil(F.col("c") / F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_SHINGLES) / F.col("most"))))).cast("int"))
    units = written(units.select("band", "step", "main", "parts"), "units")
    named = F.struct("step", "main", "part")
    blocks = units.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("band", named.alias("block"))
    tasks = blocks.withColumnRenamed("block", "x").join(blocks.withColumnRenamed("block", "y"), "band")
    tasks = tasks.filter((F.col("x") <= F.col("y")) & (F.abs(F.col("x.step") - F.col("y.step")) <= 1) & ~(F.col("x.main") & F.col("y.main")))
    tasks = tasks.withColumn("task", F.xxhash64("band", "x", "y"))
    first = tasks.select("band", "task", F.col("x").alias("block"), F.when(F.col("x") == F.col("y"), 2).otherwise(0).alias("side"))
    second = tasks.filter(F.col("x") != F.col("y")).select("band", "task", F.col("y").alias("block"), F.lit(1).alias("side"))
    members = many.join(units, ["band", "step", "main"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    members = members.select("band", named.alias("block"), "node", "label")
    rows = members.join(first.unionByName(second), ["band", "block"]).select("task", "side", "node", "label").join(sets, "node")
    rows = rows.repartition("task").sortWithinPartitions("task")

    def run(batches):
        import pyarrow as pa

        def links(held):
            a, b = ([x for x in held if x[0] in (side, 2)] for side in (0, 1))
            if not a or not b or len({x[2] for x in held}) < 2:
                return [], []
            got = [(a[i][1], b[j][1]) for i, j in joining(alike([x[3] for x in a], [x[3] for x in b], percent), [x[2] for x in a], [x[2] for x in b])]
            return [x for x, _ in got], [x for _, x in got]

        def batch(held):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in links(held)], ["a", "b"])
        now, held = None, []
        for rows in batches:
            for task, side, node, label, blob in zip(*[rows.column(n) for n in ("task", "side", "node", "label", "hashes")]):
                if task.as_py() != now:
                    if held:
                        yield batch(held)
                    now, held = task.as_py(), []
                held.append((side.as_py(), node.as_py(), label.as_py(), np.frombuffer(blob.as_buffer(), np.uint64).copy()))
        if held:
            yield batch(held)
    return written(rows.select("task", "side", "node", "label", "hashes").mapInArrow(run, "a binary, b binary"), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for all nodes of ``links`` (a, b): each link's ends are drawn to the least neighbour and the
    graph shrinks, until no link is left. Each round is a written table."""
    names, edges = None, links.filter(F.col("a") != F.col("b"))
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        least = written(least, "least")
        if names is None:
            names = least.select("node", F.col("to").alias("label"))
        else:
            step = least.select(F.col("node").alias("label"), "to")
            names = written(names.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "names")
        a, b = (least.select(F.col("node").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab")
        edges = edges.join(a, "a").join(b, "b").filter(F.col("to_a") != F.col("to_b"))
        edges = written(edges.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return names


def linked_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_shingles, label (of its component; null without a word),
    component_id (smallest id)."""
    sig = signatures(docs, doc_id, text, percent, shingle)
    classes = sig.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("rows"))
    classes = written(classes, "classes")
    rows = classes.select("node", F.col("n"), F.explode("bands").alias("band"))
    many = rows.groupBy("band").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("band")
    rows = written(rows.join(many, "band"), "bands")
    wanted = written(rows.select("node").distinct().join(classes.select("node", "rep"), "node"), "wanted")
    sets = sets_of(docs, wanted, doc_id, text, shingle)
    labels, links, tried = None, None, None
    for r in range(ROUNDS):
        member = rows if labels is None else rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        turn = F.struct(F.xxhash64("node", F.lit(r)).alias("h"), F.col("node"), F.col("n"), *([F.col("label")] if labels is not None else []))
        heads = member.groupBy("band").agg(F.min(turn).alias("c"))
        j = member.join(heads, "band").filter((F.col("node") != F.col("c.node")) & (F.least("n", "c.n") * 100 >= F.greatest("n", "c.n") * percent))
        if labels is not None:
            j = j.filter(F.col("label") != F.col("c.label"))
        pairs = j.select(F.col("c.node").alias("centre"), F.col("node").alias("member")).distinct()
        if tried is not None:
            back = tried.select(F.col("member").alias("centre"), F.col("centre").alias("member"))
            pairs = pairs.join(tried.unionByName(back), ["centre", "member"], "left_anti")
        pairs = written(pairs, "pairs")
        if pairs.isEmpty():
            break
        tried = pairs if tried is None else tried.unionByName(pairs)
        more = verified(pairs, sets, percent)
        links = more if links is None else links.unionByName(more)
        labels = components(links)
    rest = remaining(rows, labels)
    more = verified(few_pairs(rest, tried, percent), sets, percent).unionByName(block_links(rest, sets, percent))
    if not more.isEmpty():
        labels = components(more if links is None else links.unionByName(more))
    # class -> component among the classes, then one look-up per document: neither large classes nor large components are dealt by key
    own = classes.select("node", "rep", "rows")
    own = own.join(labels, "node", "left") if labels is not None else own.withColumn("label", F.lit(None).cast("binary"))
    own = written(own.withColumn("label", F.coalesce("label", "node")), "named")
    per = written(own.groupBy("label").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n")), "components")
    table = written(lookup(own.drop("rep"), per, "label").select("node", F.col("rows").alias("n"), "label", "component_id"), "looked-up")
    out = lookup(sig.select("doc_id", "text_hash", "n_shingles", "node"), table, "node").drop("node")
    return out.withColumn("component_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Null, empty or wordless text: no shingles, linked with nothing.  Repeated rows and exact copies: one class,
    linked.  Rows of one id: each by its own text; a null id is larger than all others, and a component of null
    ids only has a null id and keeps its rows.  Empty table: no rows.  Other columns are not read.
    """
    out = linked_rows(docs, doc_id, text, percent, shingle)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component of ``docs`` (doc_id, text, ...): that of smallest id, of equal ids that of the least
    text hash, of equal rows one.  Rows without a word (null or empty text too) all stay.  Very long texts are compared
    whole.  Empty table: no rows.  Columns unchanged."""
    rows = linked_rows(docs, percent=percent, shingle=shingle).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    per = rows.filter(F.col("label").isNotNull()).groupBy("label", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    one = per.groupBy("label").agg(F.min(F.struct("text_hash", "n", "doc_id")).alias("c"))
    bare = rows.filter(F.col("label").isNull()).select("doc_id", "text_hash").distinct()
    chosen = one.select(F.col("c.doc_id").alias("_id"), F.col("c.text_hash").alias("_hash"), F.col("c.n").alias("_n")).unionByName(
        bare.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.lit(1).cast("long").alias("_n")))
    whole = docs.select(F.struct("*").alias("_row"))  # so that no column of the table can clash with those of the join
    j = whole.join(written(chosen, "kept"), F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("_row.text") == F.col("_hash")))
    again = j.filter("_n > 1").groupBy("_id", "_hash").agg(F.first("_row").alias("_row"))  # rows equal in id and text
    return j.filter("_n = 1").select("_row.*").unionByName(again.select("_row.*"))


ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(len(w), {SHINGLE}) - 1], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), {SHINGLE}) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
both_ AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON reach.b = both_.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT comp.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, comp.doc_id = component_id AS kept
FROM comp LEFT JOIN n ON n.doc_id = comp.doc_id
"""
