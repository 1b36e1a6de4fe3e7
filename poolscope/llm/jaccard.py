"""N-gram Jaccard join by prefixes under several global token orders.

Two texts link when their sets of distinct word 5-grams reach a Jaccard
similarity of 75 %. Under any total order of the tokens, linked sets share a
token among the first ``n - ceil(0.75 n) + 1`` of each. Candidates must share
such prefix tokens under every one of ``ORDERS`` orders, and the position of
the shared token must leave room for the overlap; then the sets are compared.

All orders put frequent tokens last. Frequency comes from counts over all
documents in a table of ``2**SKETCH_BITS`` cells, whose size never grows; a cell
only influences the order, never the result. A token of an ordinary cell is
grouped in one window, whose size the cell's count bounds; tokens of frequent
cells are grouped in ``SALTS`` parts, whose leaders are then aggregated.

Large groups are not paired out: each member of a token's group is first
compared with the group's cleanest member, components are formed, and only
members of different components that still pass the filters are compared. That
loses no link between components, which is all the result needs. Equal sets, by
a 64-bit hash together with the size, join one component without comparison.

Every document has a sketch of ``BITS`` bits, each the parity of the tokens hashed to it. Two
sketches differ in at most as many bits as there are tokens in just one of the sets, and linked sets
have few of those, so pairs whose sketches differ more are dropped on ids, inside
the join where members of different components meet, before any text moves.

Defined results: null text or no words: empty set, own component. Null ids:
``component_id`` null, linked with nothing. Repeated rows (same id and text): equal
results; an id is taken to name one text. Empty table: empty result. Other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolscope.llm.tables import components, join_by_size, stored
from poolscope.llm.words import byte_texts, mix, signed, windows, prefix_hash, word_hashes

N = 5
PERCENT = 75
SKETCH_BITS = 22
CHUNK_BITS = 16
ORDERS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)
ROWS = 200_000
SALTS = 64
PART = 500
BITS = 1024
WORDS = [f"b{i}" for i in range(BITS // 64)]
SKETCH_BYTES = 16 * len(WORDS)


def shingles(text: bytes | None, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; the whole sequence if it is shorter."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = word_hashes(words)
    width = min(n, len(words))
    found = np.sort(windows(prefix_hash(hashes), width))
    return found[np.concatenate(([True], found[1:] != found[:-1]))]


def class_of(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64))


def parities(tokens: np.ndarray) -> np.ndarray:
    """The sketch of a set: for each bit whether an odd number of tokens is hashed to it."""
    odd = np.bincount((tokens & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


class TokenOrder:
    """A total order: rare cells first, then a hash."""

    def __init__(self, levels: np.ndarray, salt: int) -> None:
        self.levels, self.salt = levels, np.uint64(salt)
        self.shift = np.uint64(64 - int(len(levels)).bit_length() + 1)

    def prefix(self, tokens: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The first tokens of the set, in order, and their levels."""
        level = self.levels[(tokens >> self.shift).astype(np.int64)].astype(np.uint64)
        key = (level << np.uint64(58)) | (mix(tokens ^ self.salt) >> np.uint64(6))
        first = np.argsort(key, kind="stable")[:length]
        return tokens[first], level[first]


def _new_sets(batches: Iterator[pa.RecordBatch], n: int):
    """(id, tokens) of rows with words, once for equal sets of a task."""
    seen: set[int] = set()
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
            tokens = shingles(text, n)
            if len(tokens) and (cls := class_of(tokens)) not in seen:
                seen.add(cls)
                yield doc, tokens


def classes_and_counts(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """(doc_id, n, cls, chunk, counts, b0...): a row per document with its sketch, and the task's cell counts.

    Counts are fixed tables of a task, cut into compressed chunks; rows of documents
    have no chunk. Without words n is 0 and there is no class.
    """
    chunks, width = 1 << (bits - CHUNK_BITS), 1 << CHUNK_BITS
    shift = np.uint64(64 - bits)
    names = ["doc_id", "n", "cls", "chunk", "counts", *WORDS]
    empty = np.zeros(len(WORDS), np.int64)

    def run(batches):
        cells, seen = np.zeros(1 << bits, np.uint16), set()
        for batch in batches:
            size, classes, sketches = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
                tokens = shingles(text, n)
                cls = class_of(tokens) if len(tokens) else None
                size.append(len(tokens))
                classes.append(cls)
                sketches.append(empty if cls is None else parities(tokens))
                if cls is not None and doc is not None and cls not in seen:
                    seen.add(cls)
                    at = np.unique((tokens >> shift).astype(np.int64))
                    cells[at] += cells[at] < 65535
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(classes, pa.int64()),
                 none.cast(pa.int32()), none.cast(pa.binary()), *map(pa.array, np.array(sketches, np.int64).reshape(-1, len(WORDS)).T)],
                names,
            )
        none = pa.nulls(chunks, pa.int64())
        parts = [zlib.compress(cells[i * width : (i + 1) * width].tobytes(), 1) for i in range(chunks)]
        yield pa.RecordBatch.from_arrays(
            [none, none, none, pa.array(range(chunks), pa.int32()), pa.array(parts, pa.binary()), *[none] * len(WORDS)], names
        )

    words = "".join(f", {w} long" for w in WORDS)
    return docs.mapInArrow(run, "doc_id long, n long, cls long, chunk int, counts binary" + words)


def frequency_levels(counted: DataFrame, bits: int) -> np.ndarray:
    """Per cell 0 for an ordinary count, else one more for every doubling beyond it."""
    chunks, width = 1 << (bits - CHUNK_BITS), 1 << CHUNK_BITS

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cells = np.frombuffer(zlib.decompress(part), np.uint16)
                total[i] = total[i] + cells if i in total else cells.astype(np.uint32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())],
            ["chunk", "counts"],
        )

    counts = np.zeros((chunks, width), np.uint32)
    summed = counted.filter("chunk is not null").select("chunk", "counts").repartition("chunk")
    for row in summed.mapInArrow(add, "chunk int, counts binary").collect():
        counts[row.chunk] = np.frombuffer(row.counts, np.uint32)
    mean = counts.mean()
    usual = mean + 4 * np.sqrt(mean) + 4
    return np.ceil(np.log2(np.maximum(counts.ravel(), 1) / usual)).clip(0, 62).astype(np.uint8)


# A prefix row is two longs. From the top of the first: 43 bits of the token,
# whether its cell is frequent, floor(32 log2 n), and floor(1024 (i - 1) / n) of
# its position i. Rounded values only loosen the filters.
SIZE_STEPS, PLACE_STEPS = 32, 1024
FREQUENT = 1 << 20


def pack(tokens: np.ndarray, level: np.ndarray, n: int) -> np.ndarray:
    size = min(int(SIZE_STEPS * np.log2(n) + 1e-9), 1023)
    place = PLACE_STEPS * np.arange(len(tokens)) // n
    low = (level > 0).astype(np.uint64) << np.uint64(20) | np.uint64(size << 10) | place.astype(np.uint64)
    return signed((tokens >> np.uint64(21)) << np.uint64(21) | low)


def prefix_rows(docs: DataFrame, levels, n: int, percent: int) -> DataFrame:
    """(x, doc_id): the packed prefix of each set under the first order."""

    def run(batches):
        order = TokenOrder(levels.value, ORDERS[0])
        held, rows = [], 0

        def flush():
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["x", "doc_id"])

        for doc, tokens in _new_sets(batches, n):
            first, level = order.prefix(tokens, prefix_length(len(tokens), percent))
            held.append((pack(first, level, len(tokens)), np.full(len(first), doc, np.int64)))
            rows += len(first)
            if rows >= ROWS:
                yield flush()
                held, rows = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "x long, doc_id long")


def _place(x: str) -> Column:
    return F.col(x).bitwiseAND(1023)


def _size(x: str) -> Column:
    return F.shiftright(x, 10).bitwiseAND(1023)


def may_link(x1: str, x2: str, percent: int) -> Column:
    """Sizes allow a link, and enough tokens follow when this is the first shared one."""
    least1, least2 = (F.pow(F.lit(2.0), _size(x) / SIZE_STEPS) for x in (x1, x2))
    step = 2.0 ** (1 / SIZE_STEPS)
    room = step * F.least(*[n * (1 - _place(x) / PLACE_STEPS) for n, x in ((least1, x1), (least2, x2))])
    slack = 1.0001
    return (100 * slack * step * F.least(least1, least2) >= percent * F.greatest(least1, least2)) & (
        (100 + percent) * slack * room >= percent * (least1 + least2)
    )


def shared_tokens(rows: DataFrame) -> DataFrame:
    """(token, x, doc_id, lead, lead_x): rows whose token others may share, with a leader.

    The leader is the member with the fewest tokens before this one. Rows of
    frequent tokens are all kept; their leader is that of their salted part.
    """
    token = F.shiftrightunsigned("x", 21)
    salt = F.when(F.col("x").bitwiseAND(FREQUENT) != 0, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0)
    group = Window.partitionBy("token", "salt")
    clean = F.struct(_place("x").alias("f"), F.col("doc_id").alias("lead"), F.col("x").alias("lead_x"))
    return (
        rows.repartition(token, salt).withColumns({"token": token, "salt": salt})
        .withColumn("members", F.count("*").over(group))
        .filter((F.col("members") > 1) | (F.col("x").bitwiseAND(FREQUENT) != 0))
        .withColumn("first", F.min(clean).over(group))
        .select("token", "x", "doc_id", "first.lead", "first.lead_x")
    )


def leads(shared: DataFrame, percent: int) -> DataFrame:
    """(hub, member): every member with the leader of its token's whole group."""
    frequent = F.col("x").bitwiseAND(FREQUENT) != 0
    clean = F.struct(_place("lead_x").alias("f"), "lead", "lead_x")
    tops = shared.filter(frequent).groupBy("token").agg(F.min(clean).alias("top"))
    tops = stored(tops.select("token", "top.lead", "top.lead_x"), "jaccard-tops")
    whole = join_by_size(shared.filter(frequent).select("token", "x", "doc_id"), tops, "token", "inner")
    rows = shared.filter(~frequent).unionByName(whole)
    return (
        rows.filter(F.col("doc_id") != F.col("lead")).filter(may_link("x", "lead_x", percent))
        .select(F.col("lead").alias("hub"), F.col("doc_id").alias("member")).distinct()
    )


def enough_shared(n1: Column, n2: Column, percent: int) -> Column:
    """The least number of common prefix tokens of linked sets with these least sizes.

    The prefix that ends first lies wholly before the other's end, so each of its
    tokens is common or one of the few that a link lets it lack.
    """
    step = 2.0 ** (1 / SIZE_STEPS)
    whole = percent / (100 + percent) * (n1 + n2)
    return whole - percent / 100 * step * 1.0001 * F.greatest(n1, n2)


def close(left: str, right: str, percent: int) -> Column:
    """Sizes and sketches, in columns with these prefixes, allow a link."""
    n1, n2 = F.col(left + "n"), F.col(right + "n")
    differ = sum((F.bit_count(F.col(left + w).bitwiseXOR(F.col(right + w))) for w in WORDS), F.lit(0))
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (
        (100 + percent) * differ <= (100 - percent) * (n1 + n2)
    )


def with_sketch(rows: DataFrame, sketches: DataFrame, id_: str, prefix: str) -> DataFrame:
    named = sketches.select(F.col("doc_id").alias(id_), *[F.col(c).alias(prefix + c) for c in ("n", *WORDS)])
    return join_by_size(rows, named, id_, "inner", row_bytes=SKETCH_BYTES)


def close_pairs(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (hub, member) whose sketches allow a link."""
    both = with_sketch(with_sketch(pairs, sketches, "hub", "h_"), sketches, "member", "m_")
    return both.filter(close("h_", "m_", percent)).select("hub", "member")


def across_components(open_: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(hub, member): pairs of different components that pass all filters of the first order."""
    own = stored(with_sketch(open_, sketches, "doc_id", "k_"), "jaccard-sketched")
    other = own.select(*[F.col(c).alias("o_" + c) for c in own.columns])
    n1, n2 = (F.pow(F.lit(2.0), _size(x) / SIZE_STEPS) for x in ("x", "o_x"))
    differ = (F.col("doc_id") < F.col("o_doc_id")) & (F.col("root") != F.col("o_root"))
    return (
        own.join(other, (F.col("token") == F.col("o_token")) & differ & close("k_", "o_k_", percent))
        .groupBy(F.col("doc_id").alias("hub"), F.col("o_doc_id").alias("member"))
        .agg(
            F.count("*").alias("common"), F.max(may_link("x", "o_x", percent)).alias("may"),
            F.max(enough_shared(n1, n2, percent)).alias("least"),
        )
        .filter("may and common >= least").select("hub", "member")
    )


def linked(pairs: DataFrame, docs: DataFrame, levels, n: int, percent: int, label: str) -> DataFrame:
    """Pairs (hub, member) of ids that share prefix tokens in every order and do link.

    Texts are brought together at the hub, in parts of about ``PART`` members, the
    hub's own text first, so a task keeps one set and streams the members.
    """
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / PART).alias("parts"))
    placed = pairs.join(parts, "hub").select(
        "hub", "member", F.pmod(F.xxhash64("member"), F.col("parts")).alias("part")
    )
    placed = stored(placed, f"{label}-parts")
    hubs = placed.select("hub", "part").distinct()
    roles = stored(
        placed.select(F.col("member").alias("doc_id"), "hub", "part", F.lit(1).alias("role"))
        .unionByName(hubs.select(F.col("hub").alias("doc_id"), "hub", "part", F.lit(0).alias("role"))),
        f"{label}-roles",
    )
    together = (
        join_by_size(docs, roles, "doc_id", "inner")
        .select("hub", "part", "role", "doc_id", "text")
        .repartition("hub", "part").sortWithinPartitions("hub", "part", "role")
    )

    def run(batches):
        orders = [TokenOrder(levels.value, salt) for salt in ORDERS[1:]]
        hub, own, heads = None, None, []
        for batch in batches:
            found = []
            ids = zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 3)], byte_texts(batch.column(4)), strict=True)
            for key, part, role, doc, text in ids:
                tokens = shingles(text, n)
                length = prefix_length(len(tokens), percent)
                if role == 0:
                    hub, own = (key, part), tokens
                    heads = [o.prefix(own, length)[0] for o in orders]
                    continue
                if hub != (key, part):
                    raise ValueError(f"no text of hub {key}")
                shares = all(np.isin(o.prefix(tokens, length)[0], h).any() for o, h in zip(orders, heads, strict=True))
                if shares:
                    common = len(np.intersect1d(own, tokens, assume_unique=True))
                    if (100 + percent) * common >= percent * (len(own) + len(tokens)):
                        found.append((key, doc))
            columns = list(zip(*found, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    return together.mapInArrow(run, "a long, b long")


def jaccard_components(
    docs: DataFrame, n: int = N, percent: int = PERCENT, sketch_bits: int = SKETCH_BITS
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest id reachable by links, the row's own included.
    """
    docs = docs.select("doc_id", "text")
    known = docs.filter("doc_id is not null")
    counted = stored(classes_and_counts(docs, n, sketch_bits), "jaccard-classes")
    classed = counted.filter("chunk is null").select("doc_id", "n", "cls")
    with_words = classed.filter("cls is not null and doc_id is not null")
    heads = with_words.groupBy("cls", "n").agg(F.min("doc_id").alias("a"), F.count("*").alias("c")).filter("c > 1")
    equal = stored(
        with_words.join(heads, ["cls", "n"]).select("a", F.col("doc_id").alias("b")).filter("a <> b"), "jaccard-equal"
    )
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(counted, sketch_bits))
    shared = stored(shared_tokens(prefix_rows(known, levels, n, percent)), "jaccard-shared")

    sketch = F.max(F.struct("n", *WORDS)).alias("s")
    sketches = counted.filter("chunk is null and doc_id is not null and cls is not null").groupBy("doc_id").agg(sketch)
    sketches = stored(sketches.select("doc_id", "s.*"), "jaccard-sketches")
    to_lead = stored(close_pairs(leads(shared, percent), sketches, percent), "jaccard-leads")
    first = stored(linked(to_lead, known, levels, n, percent, "jaccard-first"), "jaccard-links")
    groups = stored(components(first.unionByName(equal), "jaccard-first"), "jaccard-groups")

    # Tokens whose members are still in several components.
    placed = join_by_size(shared.select("token", "x", "doc_id"), groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    placed = placed.withColumn("root", F.coalesce("root", "doc_id"))
    split = placed.groupBy("token").agg(F.min("root").alias("s"), F.max("root").alias("t")).filter("s <> t").select("token")
    open_ = stored(placed.join(split, "token", "left_semi"), "jaccard-open")
    rest = stored(across_components(open_, sketches, percent), "jaccard-rest")
    second = linked(rest, known, levels, n, percent, "jaccard-second")
    left = groups.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    right = groups.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    across = second.join(left, "a", "left").join(right, "b", "left").select(
        F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")
    )
    joined = components(across, "jaccard-last").select(F.col("node").alias("_node"), F.col("root").alias("top"))
    own = F.col("doc_id")
    rooted = stored(
        classed.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .withColumn("root", F.coalesce("root", own))
        .join(joined, F.col("root") == F.col("_node"), "left")
        .select("doc_id", "n", F.coalesce("top", "root").alias("root")),
        "jaccard-roots",
    )
    least = stored(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "jaccard-least")
    return join_by_size(rooted, least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
