"""Exact nearest codes in Hamming distance by multi-index hashing with growing radii.

A code of 64 bits is cut into m segments. Two codes at distance d agree in some segment up to d // m bits, so codes
that no segment finds within radius r are further away than m * (r + 1) - 1. The radius grows shell by
shell and, within a shell, by segments: with the first a of them at radius r, distances up to m * r + a - 1 are covered. A
query stops when its last neighbour, whose distance is verified on the whole codes, lies within what is covered, and
never probes more segments than that takes.

A segment's table of codes is dealt into cells by the upper bits of its value, and large cells into shares. A query goes
to the cells that its flips can reach, one row each; the task that has the cell looks up the flipped values in the sorted
table and passes on the nearest codes only. So neither probes nor codes that are met become rows.

Equal codes share one index entry with their smallest ids, and equal queries one search: a code that holds a third
of all rows is one row here.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholium.llm.texts import field_type, schema
from scholium.plans import cut_lineage

BITS = 64
CELL_CODES = 1 << 14  # codes of a segment's table that one task has at a time, about


def sign_code(vector: Column) -> Column:
    """Bit i is set where element i is not negative. A missing element gives 0; a null vector gives null.

    A vector of another width than 64 is an error.
    """
    signs = F.transform(vector, lambda x, i: F.when(x >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(signs, F.lit(0).cast("long"), lambda total, bit: total.bitwiseOR(bit))
    wrong = F.raise_error(F.concat(F.lit("binary codes need 64 elements, not "), F.size(vector).cast("string"))).cast("long")
    return F.when(vector.isNull(), F.lit(None).cast("long")).when(F.size(vector) == BITS, code).otherwise(wrong)


def segment_widths(codes: int) -> list[int]:
    """As many segments as leave about one code per segment value, of at most 24 bits each."""
    target = min(24, max(8, round(math.log2(max(1, codes)))))
    count = -(-BITS // target)
    return [BITS // count + (i < BITS % count) for i in range(count)]


def _segments(code: Column, widths: list[int]) -> list[Column]:
    out, at = [], 0
    for width in widths:
        out.append(F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << width) - 1).cast("long")).cast("int"))
        at += width
    return out


def _nearest(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` nearest codes of each query code; a shuffle sends at most that many per task and query."""
    window = Window.partitionBy("q").orderBy("distance", "least_id", "code")
    return found.withColumn("_at", F.row_number().over(window)).where(F.col("_at") <= most).drop("_at")


def _reached(segment: int, upper: Column, bits: int, radius: int) -> Column:
    """The cells of a segment, ``bits`` wide, that differ from ``upper`` in at most ``radius`` bits, as (segment, cell)."""
    masks = [sum(1 << b for b in flips) for r in range(min(bits, radius) + 1) for flips in combinations(range(bits), r)]
    flips = F.from_json(F.lit(str(masks)), "array<int>")  # folded to one literal
    return F.transform(flips, lambda mask: F.struct(F.lit(segment).alias("segment"), upper.bitwiseXOR(mask).alias("cell")))


def _masks(width: int, radius: int) -> np.ndarray:
    flips = np.array(list(combinations(range(width), radius)), dtype=np.int64).reshape(math.comb(width, radius), radius)
    return (np.int64(1) << flips).sum(axis=1)


def _cell_search(widths: list[int], bits: int, radius: int, keep: int):
    """Function of a cell's codes and queries: per query the nearest codes that this segment and radius meet first."""
    starts = np.cumsum([0, *widths])[:-1]
    masks: dict[tuple[int, int], np.ndarray] = {}

    def apart_in(x: np.ndarray, segment: int) -> np.ndarray:
        part = (x >> np.uint64(starts[segment])) & np.uint64((1 << widths[segment]) - 1)
        return np.bitwise_count(part).astype(np.int64)

    def search(key: tuple, codes: pa.Table, queries: pa.Table) -> pa.Table:
        segment, cell = key[0].as_py(), key[1].as_py()
        low = widths[segment] - bits
        code = codes.column("code").to_numpy().view(np.uint64)
        value = ((code >> np.uint64(starts[segment])) & np.uint64((1 << widths[segment]) - 1)).astype(np.int64)
        order = np.argsort(value, kind="stable")
        code, value = code[order], value[order]
        # Ids of any type as numbers of the same order.
        rank = np.unique(codes.column("least_id").to_numpy(), return_inverse=True)[1][order]
        rows, owners, distances = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for q, last in zip(queries.column("q").to_numpy().view(np.uint64), queries.column("last").fill_null(BITS).to_numpy()):
            own = int((q >> np.uint64(starts[segment])) & np.uint64((1 << widths[segment]) - 1))
            flips = radius - ((own >> low) ^ cell).bit_count()
            if not 0 <= flips <= low:
                continue
            if math.comb(low, flips) < len(code):
                if (low, flips) not in masks:
                    masks[low, flips] = _masks(low, flips)
                probes = ((cell << low) | (own & ((1 << low) - 1))) ^ masks[low, flips]
                begin, end = np.searchsorted(value, probes), np.searchsorted(value, probes, side="right")
                length = end - begin
                met = np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())
            else:
                # Fewer codes than probes: the same codes by going through the table.
                met = np.flatnonzero(np.bitwise_count(value ^ own) == radius)
            apart = code[met] ^ q
            distance = np.bitwise_count(apart).astype(np.int64)
            first = distance <= last
            for other in range(len(widths)):
                if other != segment:
                    first &= apart_in(apart, other) >= radius + (other < segment)
            met, distance = met[first], distance[first]
            best = np.lexsort((code[met].view(np.int64), rank[met], distance))[:keep]
            rows.append(order[met[best]])
            owners.append(np.full(len(best), q))
            distances.append(distance[best])
        found = codes.select(["code", "least_id", "n"]).take(pa.array(np.concatenate(rows)))
        found = found.append_column("distance", pa.array(np.concatenate(distances)))
        return found.add_column(0, "q", pa.array(np.concatenate(owners).view(np.int64)))

    return search


def nearest_codes(
    vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """For each query row its ``k`` nearest other rows: query_id, rank, neighbor_id, distance.

    Ties in distance go to the smaller id. A query is not its own neighbour, but another row with the same
    vector is. Fewer than ``k`` other rows give fewer neighbours. Rows with a null id or vector are neither
    queries nor neighbours; rows that repeat an id count once per distinct code. Other columns are not read.
    """
    rows = vectors.select(F.col(id_column).alias("id"), sign_code(F.col(vector_column)).alias("code"), is_query.alias("asks"))
    rows = cut_lineage(rows.where("id is not null and code is not null").distinct())
    keep = k + 1  # a query's own row may be among them
    by_code = Window.partitionBy("code").orderBy("id")
    index = cut_lineage(
        rows.withColumn("_at", F.row_number().over(by_code))
        .where(F.col("_at") <= keep)
        .groupBy("code")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
        .withColumn("least_id", F.element_at("ids", 1))
    )
    codes = index.count()
    widths = segment_widths(codes)
    count = len(widths)
    bits = min(max(0, math.ceil(math.log2(max(1, codes) / CELL_CODES))), *widths)
    uppers = lambda code: [F.shiftright(part, w - bits) for part, w in zip(_segments(code, widths), widths)]
    cells = F.array(*[F.struct(F.lit(i).alias("segment"), upper.alias("cell")) for i, upper in enumerate(uppers(F.col("code")))])
    entries = index.select("code", "least_id", F.size("ids").cast("long").alias("n"), F.inline(cells))
    # A cell with more codes than two tasks' worth is dealt into shares; queries go to all of them.
    shares = cut_lineage(entries.groupBy("segment", "cell").agg(F.ceil(F.count("*") / (2 * CELL_CODES)).cast("int").alias("shares")))
    entries = entries.join(shares, ["segment", "cell"]).withColumn("share", F.pmod(F.xxhash64("code"), "shares").cast("int"))
    at = ["segment", "cell", "share"]
    tables = entries.select(*at, "code", "least_id", "n").groupBy(*at)
    met_type = schema(("q", "long"), ("code", "long"), ("least_id", field_type(index, "least_id")), ("n", "long"), ("distance", "long"))
    asked = cut_lineage(rows.where("asks").select(F.col("code").alias("q")).distinct())
    open_queries, best, done = asked.withColumn("last", F.lit(None).cast("int")), None, []
    for radius in range(max(widths) + 1):
        # As many segments as cover the last neighbour known so far.
        needed = F.least(F.coalesce(F.col("last") - count * radius + 1, F.lit(count)), F.lit(count))
        asking_now = open_queries.withColumn("segments", needed)
        # Only the cells of segments that are asked.
        reach = [
            F.when(F.col("segments") > i, _reached(i, upper, bits, radius))
            for i, upper in enumerate(uppers(F.col("q")))
        ]
        asks = asking_now.select("q", "last", F.explode(F.filter(F.array(*reach), lambda cells: cells.isNotNull())).alias("cells"))
        asks = asks.select("q", "last", F.inline("cells")).join(shares, ["segment", "cell"])
        asks = asks.select("q", "last", "segment", "cell", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
        fresh = tables.cogroup(asks.groupBy(*at)).applyInArrow(_cell_search(widths, bits, radius, keep), met_type)
        found = fresh if best is None else best.unionByName(fresh)
        found = cut_lineage(_nearest(found, keep))
        # Rows up to the keep-th, and the distance of that one.
        ahead = F.sum("n").over(Window.partitionBy("q").orderBy("distance", "least_id", "code"))
        reach = found.withColumn("_ahead", ahead).groupBy("q").agg(
            F.min(F.when(F.col("_ahead") >= keep, F.col("distance"))).cast("int").alias("now"),
            F.count("*").alias("seen"),
        )
        covered = F.col("segments") + (count * radius - 1)
        settled = F.coalesce(F.col("now") <= covered, F.lit(False)) | F.coalesce(F.col("seen") >= codes, F.lit(False))
        state = asking_now.join(reach, "q", "left").withColumn("settled", settled)
        state = cut_lineage(state.select("q", F.col("now").alias("last"), "settled"))
        done.append(found.join(state.where("settled"), "q", "left_semi"))
        open_queries = state.where("not settled").select("q", "last")
        if open_queries.isEmpty():
            break
        best = found.join(open_queries, "q", "left_semi")
    else:
        done.append(best)
    near = done[0]
    for more in done[1:]:
        near = near.unionByName(more)
    items = near.join(index.select("code", "ids"), "code").groupBy("q").agg(
        # At most keep codes of at most keep ids each.
        F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("distance"), i.alias("id")))))).alias("items")
    )
    asking = rows.where("asks").select(F.col("id").alias("query_id"), F.col("code").alias("q"))
    others = F.slice(F.filter("items", lambda item: item["id"] != F.col("query_id")), 1, k)
    ranked = asking.join(items, "q").select("query_id", F.posexplode(others).alias("at", "item"))
    return ranked.select(
        "query_id",
        (F.col("at") + 1).alias("rank"),
        F.col("item.id").alias("neighbor_id"),
        F.col("item.distance").cast("int").alias("distance"),
    )


def nearest_codes_sql(table: str, condition: str, k: int = 10) -> str:
    """The same rows by comparing every query with every row."""
    bits = " + ".join(f"(CASE WHEN embedding[{i + 1}] >= 0 THEN {1 << i}::HUGEINT ELSE 0 END)" for i in range(BITS))
    return f"""
    WITH codes AS MATERIALIZED (
        SELECT vec_id AS id, ({bits})::UBIGINT AS code FROM {table} WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    ), pairs AS (
        SELECT q.id AS query_id, r.id AS neighbor_id, bit_count(xor(q.code, r.code))::INTEGER AS distance
        FROM (SELECT * FROM codes WHERE {condition.format("id")}) q JOIN codes r ON q.id <> r.id
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INTEGER AS rank FROM pairs
    )
    SELECT query_id, rank, neighbor_id, distance FROM ranked WHERE rank <= {k}
    """
