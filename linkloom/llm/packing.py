"""Documents into containers of fixed capacity: shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

from collections import defaultdict
from heapq import heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.tokens import VOCABULARY, with_token_counts
from linkloom.runtime import cut

#: Hash parts in which the documents of one length are numbered, so that a length many documents share isn't one task.
RANK_PARTS = 256


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Packs histogram[length] items of each length, longest first, into the packs that are shortest so far.

    Returns slots (length, pattern, packs, per_pack): every one of the ``packs`` packs of ``pattern`` takes ``per_pack``
    items of ``length``. Packs that are alike are handled together, so the work depends on the number of lengths (at most
    ``capacity``), not of items.
    """
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free room -> (packs, last slot) of packs alike
    rooms: list[int] = []  # heap of -room
    chain: list[tuple[int, int, int]] = [(-1, 0, 0)]  # slot before, length, items per pack

    def put(room: int, packs: int, node: int) -> None:
        if not groups[room]:
            heappush(rooms, -room)
        groups[room].append((packs, node))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        moved: list[tuple[int, int, int]] = []
        # packs that stay the shortest after taking an item take more of them; equal packs share the items in one step
        while left and rooms and -rooms[0] >= length:
            room = -rooms[0]
            packs, node = groups[room].pop()
            if not groups[room]:
                heappop(rooms)
            below = -rooms[0] if rooms else 0
            each = max(1, min(left // packs, (room - max(below, length)) // length + 1)) if left >= packs else 1
            each = min(each, room // length)
            taking = packs if left >= packs else left
            if taking < packs:
                put(room, packs - taking, node)
            left -= taking * each
            chain.append((node, length, each))
            put(room - length * each, taking, len(chain) - 1)
        if left:
            fit = capacity // length
            for packs, each in ((left // fit, fit), (1, left % fit)):
                if packs and each:
                    chain.append((0, length, each))
                    moved.append((capacity - length * each, packs, len(chain) - 1))
        for m in moved:
            put(*m)
    slots, pattern = [], 0
    for alike in groups.values():
        for packs, node in alike:
            per: dict[int, int] = defaultdict(int)
            while node:
                node, length, each = chain[node]
                per[length] += each
            slots += [(length, pattern, packs, each) for length, each in per.items()]
            pattern += 1
    return slots


def pack_documents(documents: DataFrame, capacity: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece_no, n_pieces, n_tokens, container_id) of every document that has tokens.

    A document is cut only if it alone exceeds ``capacity``: into full pieces, which fill a container each, and a rest that
    is packed as any other item. Only the histogram of lengths, at most ``capacity`` rows, comes to the driver. Null and
    empty texts take no container; an empty table gives no rows. Equal lengths are interchangeable: which of them shares a
    pack with whom follows from the hash of doc_id. Further columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    sizes = cut(with_token_counts(documents.where("doc_id is not null and text is not null"), "text", ["doc_id"], vocabulary).where("n_tokens > 0"))
    rest = (F.col("n_tokens") % capacity).cast("int")
    full = F.floor(F.col("n_tokens") / capacity).cast("int")
    items = sizes.select("doc_id", rest.alias("length"), full.alias("n_full"), F.pmod(F.xxhash64("doc_id"), F.lit(RANK_PARTS)).alias("part")).withColumn("n_pieces", F.col("n_full") + (F.col("length") > 0).cast("int"))

    counted = items.where("length > 0").groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, start, rows = pack_histogram(histogram, capacity), defaultdict(int), []
    for length, pattern, packs, each in slots:
        rows.append((length, pattern, each, start[length], start[length] + packs * each))
        start[length] += packs * each
    spark = documents.sparkSession
    patterns = spark.createDataFrame(rows, "length int, pattern int, each int, since bigint, until bigint")

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "part").orderBy("doc_id")
    ranked = items.where("length > 0").withColumn("own", F.row_number().over(own) - 1).join(offsets, ["length", "part"])
    rank = F.col("before") + F.col("own")
    # the patterns come from a histogram of at most ``capacity`` lengths: their number does not grow with the documents
    packed = ranked.join(F.broadcast(patterns), (ranked["length"] == patterns["length"]) & (rank >= F.col("since")) & (rank < F.col("until"))).select(
        "doc_id", F.col("n_full").alias("piece_no"), "n_pieces", ranked["length"].cast("bigint").alias("n_tokens"),
        F.concat_ws("-", F.lit("pack"), "pattern", F.floor((rank - F.col("since")) / F.col("each"))).alias("container_id"),
    )
    whole = items.where("n_full > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n_full") - 1)).alias("piece_no"), "n_pieces", F.lit(capacity).cast("bigint").alias("n_tokens"))
    return packed.unionByName(whole.withColumn("container_id", F.concat_ws("-", F.lit("full"), "doc_id", "piece_no")))


def packing_report(placed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, containers at best (tokens / capacity, rounded up), documents cut, share of room used."""
    # a container holds at most ``capacity`` pieces, so counting containers by pieces needs no distinct over wide rows
    per = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    cuts = placed.where("n_pieces > 1 and piece_no = 0").agg(F.count(F.lit(1)).alias("docs_cut"))
    totals = per.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.coalesce(F.max("used"), F.lit(0)).alias("fullest"))
    return totals.crossJoin(F.broadcast(cuts)).select(  # one row each
        "containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("containers_at_best"), "docs_cut", "fullest",
        F.when(F.col("containers") > 0, F.round(F.col("tokens") / (F.col("containers") * capacity), 6)).otherwise(1.0).alias("used_share"),
    )
