"""What the corpus operators share: shared-folder tables, skew-proof joins, bitmap filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from chronofact.shipping import ship
from chronofact.storage import join_by_key, materialise, shared_folder

__all__ = ["BitFilter", "by_slices", "id_of", "join_by_key", "lower_ascii", "materialise", "shared_folder", "text_of", "weights", "whole_row"]

#: ASCII white space, as the contracts define it: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"
#: A word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A null id sorts before every other id.
NULL_ID = -(2**63)
#: Rows whose texts a worker takes at once.
SLICE = 256


def text_of(column: str = "text") -> Column:
    """The text as a string, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_of(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column), F.lit(NULL_ID))


def weights(df: DataFrame, column: str) -> tuple[int, int]:
    """Sum and maximum of a column, 0 for an empty table: what `join_by_key` is told of a table's weights."""
    return tuple(df.agg(F.coalesce(F.sum(column), F.lit(0)), F.coalesce(F.max(column), F.lit(0))).first())


def whole_row(df: DataFrame) -> Column:
    """All columns as a struct; names are taken as they are, dots and all."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else. `lower` does just that to a text of ASCII only, and is faster than `translate`."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def by_slices(df: DataFrame, text_col: str, kinds: str, make: Callable[[list[str | None]], list]) -> DataFrame:
    """df without its text but with the columns, `kinds`, that `make` gives of the texts: SLICE rows at a time, so that a worker holds no more than their texts and results."""
    ship(df.sparkSession)
    rest = [c for c in df.columns if c != text_col]
    names = [x.split()[0] for x in kinds.split(", ")]
    schema = StructType([*df.select(*rest).schema, *StructType.fromDDL(kinds)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for part in parts:
            for a in range(0, len(part), SLICE):
                some = part.slice(a, SLICE)
                made = make(some.column(len(rest)).to_pylist())
                yield pa.RecordBatch.from_arrays([*some.columns[: len(rest)], *[pa.array(x, arrow.field(n).type) for n, x in zip(names, made, strict=True)]], [*rest, *names])

    return df.select(*rest, text_col).mapInArrow(run, schema)


class BitFilter:
    """A Bloom filter as bitmaps of SEGMENT bits, a row each. It has at most MOST_BITS (128 MB), so that it can be broadcast
    whatever it holds; with more entries than that is meant for, it passes more rows than it need, never fewer.
    """

    SEGMENT = 1 << 15
    MOST_BITS = 1 << 30

    def __init__(self, segments: DataFrame, size: int, hashes: int) -> None:
        self.segments, self.size, self.hashes = segments, size, hashes

    @classmethod
    def size_for(cls, rows: int, bits: int = 16) -> int:
        return min(cls.MOST_BITS, 1 << max(16, (max(rows, 1) * bits - 1).bit_length()))

    @staticmethod
    def positions(h: Column, size: int, hashes: int) -> list[Column]:
        """One or two positions of a 64-bit hash, from its lower and its upper half."""
        return [F.pmod(F.call_function("shiftrightunsigned", h, F.lit(32 * i)), F.lit(size)) for i in range(hashes)]

    @classmethod
    def at(cls, positions: DataFrame, size: int, hashes: int = 1) -> BitFilter:
        """positions: one bigint column, the bits to set."""
        p = F.col(positions.columns[0])
        bits = positions.groupBy(F.call_function("shiftright", p, F.lit(15)).alias("__seg")).agg(F.bitmap_construct_agg(p % cls.SEGMENT).alias("__bits"))
        # As 64-bit words, which a test reads in place.
        word = lambda i: F.conv(F.hex(F.substring("__bits", (i * 8 + 1).cast("int"), F.lit(8))), 16, -10).cast("bigint")
        return cls(materialise(bits.select("__seg", F.transform(F.sequence(F.lit(0), F.lit(cls.SEGMENT // 64 - 1)), word).alias("__words"))), size, hashes)

    @classmethod
    def of(cls, df: DataFrame, h: Column, rows: int) -> BitFilter:
        """Filter of a table's 64-bit hashes, two positions each and 16 bits a row."""
        size = cls.size_for(rows)
        return cls.at(df.select(F.explode(F.array(*cls.positions(h, size, 2))).alias("__pos")), size, 2)

    def mark(self, df: DataFrame, h: Column, flag: str) -> DataFrame:
        """df with a boolean column: whether all bits of the hash are set. Rows stay where they are."""
        kept, all_set = df.columns, F.lit(True)
        for i, p in enumerate(self.positions(h, self.size, self.hashes)):
            own = self.segments.select(F.col("__seg").alias(f"__seg{i}"), F.col("__words").alias(f"__words{i}"))
            df = df.withColumn(f"__p{i}", p).join(F.broadcast(own), F.call_function("shiftright", F.col(f"__p{i}"), F.lit(15)) == F.col(f"__seg{i}"), "left")
            at = (F.col(f"__p{i}") % self.SEGMENT).cast("int")
            word = F.get(f"__words{i}", F.call_function("shiftright", at, F.lit(6)))
            # Bytes of a word go from its upper end, bits of a byte from its lower.
            bit = (F.lit(7) - F.call_function("shiftright", at, F.lit(3)).bitwiseAND(F.lit(7))) * 8 + at.bitwiseAND(F.lit(7))
            all_set = all_set & (F.call_function("shiftright", word, bit).bitwiseAND(F.lit(1).cast("bigint")) == 1)
        return df.select(*kept, F.coalesce(all_set, F.lit(False)).alias(flag))
