"""Best-fit packing into bins of several permitted lengths.

Lengths are in bytes of UTF-8, the tokens of a byte-level model. A text is cut at code-point borders into pieces of at
most the longest length, each with its place in the text, so that bins can be built (``bin_texts``). Pieces are dealt
into groups of bounded size by a hash, as many groups as the table needs; each group is packed on its own, longest
pieces first: a piece goes into the open bin that it fills best, else into a new bin of the length that costs least per
byte it is likely to hold. When all is packed, each bin shrinks to the shortest permitted length that holds its
contents. How full new bins get depends on the pieces that are left, so a group is packed under several expectations and
the cheapest result stays; one of them opens only the longest bins, so several lengths never cost more than one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.llm._session import cut, prepare

LENGTHS = (2048, 4096, 8192, 16384, 32768)
#: Pieces of a group on average. A group is packed by one task, in memory.
GROUP_PIECES = 20_000
#: Cost of a bin of length c: OVERHEAD + c + c * c / ATTENTION.
OVERHEAD, ATTENTION = 64.0, 262_144.0
#: Shares of what a piece leaves free in a new bin that later pieces may be expected to fill; None opens the longest bin.
EXPECTED_FILLS = (0.0, 0.5, 0.8, 0.95, None)


def pieces(text: Column, longest: int) -> Column:
    """Where a text is cut: an array of (start, chars, bytes), start and chars in code points. A null or empty text is
    one empty piece. ``longest`` is 4 at least, so that a code point fits."""
    whole = F.coalesce(text, F.lit(""))
    one = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.char_length(whole).cast("bigint").alias("chars"), F.octet_length(whole).cast("bigint").alias("bytes")))
    data = whole.cast("binary")
    # a continuation byte of UTF-8 is 80 to BF; the next border at or before a place is three bytes away at most
    inside = lambda at: F.hex(F.substring(data, at + 1, F.lit(1))).between("80", "BF")
    border = lambda at: at - F.when(~inside(at), 0).when(~inside(at - 1), 1).when(~inside(at - 2), 2).otherwise(3)
    size = F.octet_length(whole)
    tries = F.sequence(F.lit(1), F.ceil(size / F.lit(longest - 3)).cast("int"))
    grown = lambda found, _: F.when(F.element_at(found, -1) + longest >= size, found).otherwise(F.array_append(found, border(F.element_at(found, -1) + longest)))
    starts = F.aggregate(tries, F.array(F.lit(0)), grown)
    cut_up = F.transform(starts, lambda at, i: F.struct(at.alias("at"), (F.coalesce(F.get(starts, i + 1), size) - at).alias("n")))
    sized = F.transform(cut_up, lambda c: F.struct(F.char_length(F.substring(data, c["at"] + 1, c["n"]).cast("string")).cast("bigint").alias("chars"), c["n"].cast("bigint").alias("bytes")))
    before = lambda i: F.aggregate(F.slice(sized, 1, i), F.lit(0).cast("bigint"), lambda a, c: a + c["chars"])
    many = F.transform(sized, lambda c, i: F.struct(before(i).alias("start"), c["chars"].alias("chars"), c["bytes"].alias("bytes")))
    return F.when(size <= longest, one).otherwise(many)


def cost(length: int) -> float:
    return OVERHEAD + length + length * length / ATTENTION


class Packer:
    """Best fit over open bins, which are listed by the room they have left."""

    def __init__(self, lengths: tuple[int, ...] = LENGTHS, fill: float | None = None):
        self.lengths, self.fill = sorted(lengths), fill
        self.by_room: list[list[int]] = [[] for _ in range(self.lengths[-1] + 1)]
        self.rooms = 0  # bit r is set if some open bin has room r
        self.filled: list[int] = []
        self.capacity: list[int] = []

    def put(self, size: int) -> int:
        fitting = self.rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bin_no = self.by_room[room].pop()
            if not self.by_room[room]:
                self.rooms &= ~(1 << room)
        else:
            length = self.lengths[-1]
            if self.fill is not None:
                length = min((c for c in self.lengths if c >= size), key=lambda c: (cost(c) / max(1.0, size + self.fill * (c - size)), c))
            bin_no, room = len(self.filled), length
            self.filled.append(0)
            self.capacity.append(length)
        self.filled[bin_no] += size
        self.by_room[room - size].append(bin_no)  # a full bin still takes pieces of no bytes
        self.rooms |= 1 << (room - size)
        return bin_no

    def downsized(self) -> list[int]:
        return [next(c for c in self.lengths if c >= held) for held in self.filled]


def pack_group(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> list[tuple[int, int, int, int]]:
    """(bin, length of the bin, offset in it, tokens held by it) of each piece, in the order given."""
    order = sorted(range(len(sizes)), key=lambda n: -sizes[n])
    best: tuple = ()
    for fill in EXPECTED_FILLS:
        packer, offsets, bins = Packer(lengths, fill), [0] * len(sizes), [0] * len(sizes)
        for n in order:
            bins[n] = packer.put(sizes[n])
            offsets[n] = packer.filled[bins[n]] - sizes[n]
        final = packer.downsized()
        total = sum(map(cost, final))
        if not best or total < best[0]:
            best = total, bins, offsets, final, packer.filled
    _, bins, offsets, final, filled = best
    return [(b, final[b], at, filled[b]) for b, at in zip(bins, offsets)]


def _packed(lengths: tuple[int, ...], names: list[str]):
    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bytes", "descending"), ("id", "ascending"), ("text_hash", "ascending"), ("copy", "ascending"), ("piece", "ascending")])
        found = pack_group(table.column("bytes").to_pylist(), lengths)
        columns = list(zip(*found)) or [(), (), (), ()]
        for name, values in zip(("bin", "capacity", "bin_offset", "bin_bytes"), columns):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table.select(names)

    return one


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """One row per piece: ``id_col, text_hash, copy, piece, start, chars, bytes, pack_group, bin, capacity, bin_offset,
    bin_bytes``.

    A piece is ``chars`` code points of its row's text from ``start`` on, ``bytes`` long, and lies at ``bin_offset`` of
    bin (``pack_group``, ``bin``), whose final length is ``capacity`` and which holds ``bin_bytes``. A null or empty text
    has one piece of no bytes, in a bin, so that no row is lost. Rows of one id and text, nulls included, are counted
    first and numbered by ``copy`` from 1, then dealt apart; rows that differ in other columns only are copies too.
    Pieces of equal size are taken in order of id (nulls last), text hash, copy and piece. Only ids, hashes and places
    are shuffled. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    longest = max(lengths)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), pieces(F.col(text_col), longest).alias("pieces"))
    alike = cut(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")))
    total = alike.agg(F.sum(F.col("copies") * F.size("pieces"))).first()[0] or 0
    groups = max(1, -(-total // GROUP_PIECES))
    each = alike.select("id", "text_hash", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"), "pieces")
    each = each.select("id", "text_hash", "copy", F.posexplode("pieces").alias("piece", "p")).select("id", "text_hash", "copy", F.col("piece").cast("bigint").alias("piece"), "p.*")
    dealt = each.withColumn("pack_group", F.pmod(F.xxhash64("id", "text_hash", "copy", "piece"), F.lit(groups)))
    kinds = dict(dealt.dtypes) | dict.fromkeys(("bin", "capacity", "bin_offset", "bin_bytes"), "bigint")
    packed = dealt.groupBy("pack_group").applyInArrow(_packed(lengths, list(kinds)), ", ".join(f"{n} {k}" for n, k in kinds.items()))
    return packed.withColumnRenamed("id", id_col)


def with_texts(packed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of ``pack`` and the text of each, as ``text``.

    Texts are read from ``docs`` by id and hash; of rows that are alike one serves all copies.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text")).dropDuplicates(["_id", "_hash"])
    found = packed.join(whole, packed[id_col].eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    return found.select(*packed.columns, F.expr("substr(_text, cast(start + 1 AS int), cast(chars AS int))").alias("text"))


def bin_texts(pieces_with_texts: DataFrame) -> DataFrame:
    """One row per bin: ``pack_group, bin, capacity, texts``, the pieces' texts by their places in the bin."""
    part = F.struct("bin_offset", F.col("bytes").alias("size"), "text")
    held = pieces_with_texts.groupBy("pack_group", "bin", "capacity").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return held.select("pack_group", "bin", "capacity", F.col("parts.text").alias("texts"))
