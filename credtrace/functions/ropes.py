"""Values that may be longer than their text, for sums of sums that double.

A value is a text, or, beyond ``TEXT`` characters, the beginning of one with a rope: its length, its last characters, how often it
holds each character, whether it holds words that decide its type, and the pieces it is made of. A piece is a text or the number
of an earlier value, so a chain of sums costs what its statements cost, whatever the length of its result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credtrace.functions import catalog as C
from credtrace.functions import text as T

TEXT = C.MAX_FILE_SIZE
#: Characters up to which a rope is put together as text where it has to be decoded.
WHOLE = 1 << 26
EDGE = 63
#: Lengths are counted up to here; a value that doubles sixty times is longer.
LONGEST = (1 << 63) - 1

PIECES = "array<struct<ref:int,text:string>>"
ROPE = f"struct<length:bigint,tail:string,chars:array<string>,counts:array<double>,words:array<boolean>,depth:int,pieces:{PIECES}>"
VALUE = f"struct<text:string,rope:{ROPE}>"
EXTENT = "struct<length:bigint,tail:string,entropy:double,white:boolean,words:array<boolean>>"
#: Words that a value may hold anywhere, and that decide on its type or against it.
WORDS = ("mongodb|postgres", T.any_of(C.PLACEHOLDER_SUBSTRINGS))


def plain(text: Column) -> Column:
    return F.struct(text.alias("text"), F.lit(None).alias("rope")).cast(VALUE)


def length(v: Column) -> Column:
    return F.coalesce(v["rope"]["length"], F.length(v["text"]).cast("bigint"))


def _spread(text: Column) -> Column:
    """struct(chars, counts) of a text."""
    return T.bind(F.array_distinct(F.split(text, "")), lambda chars: F.struct(chars.alias("chars"), F.transform(
        chars, lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double")).alias("counts")))


def joined(parts: Column) -> Column:
    """The value of ``parts`` (ref, v) one behind the other; ``ref`` is the number of a value that was kept."""
    texts = F.transform(parts, lambda p: p["v"]["text"])
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, p: F.coalesce(F.try_add(n, length(p["v"])), F.lit(LONGEST)))

    def rope(n: Column) -> Column:
        head = F.aggregate(texts, F.lit(""), lambda a, t: F.when(F.length(a) >= TEXT, a).otherwise(F.left(F.concat(a, t), F.lit(TEXT))))
        spreads = F.transform(parts, lambda p: F.when(p["v"]["rope"].isNotNull(), F.struct(
            p["v"]["rope"]["chars"].alias("chars"), p["v"]["rope"]["counts"].alias("counts"))).otherwise(_spread(p["v"]["text"])))

        def counted(ss: Column) -> Column:
            chars = F.array_distinct(F.flatten(F.transform(ss, lambda s: s["chars"])))
            return F.struct(chars.alias("chars"), F.transform(chars, lambda c: F.aggregate(ss, F.lit(0.0), lambda a, s: a + F.coalesce(
                F.get(s["counts"], F.array_position(s["chars"], c).cast("int") - 1), F.lit(0.0)))).alias("counts"))

        def edge(a: Column, p: Column) -> Column:
            text, own = p["v"]["text"], p["v"]["rope"]
            seam = F.lower(F.concat(a["tail"], F.left(text, F.lit(EDGE))))
            words = [F.get(a["words"], k) | seam.rlike(w) | F.when(own.isNotNull(), F.get(own["words"], k)).otherwise(F.lower(text).rlike(w))
                     for k, w in enumerate(WORDS)]
            return F.struct(F.right(F.concat(a["tail"], F.coalesce(own["tail"], F.right(text, F.lit(EDGE)))), F.lit(EDGE)).alias("tail"),
                            F.array(*words).alias("words"))

        ends = F.aggregate(parts, F.struct(F.lit("").alias("tail"), F.array(*[F.lit(False) for _ in WORDS]).alias("words")), edge)
        depth = F.aggregate(parts, F.lit(0), lambda a, p: F.greatest(a, F.coalesce(p["v"]["rope"]["depth"], F.lit(0)))) + 1
        pieces = F.transform(parts, lambda p: F.struct(F.when(p["v"]["rope"].isNotNull(), p["ref"]).alias("ref"),
                                                       F.when(p["v"]["rope"].isNull(), p["v"]["text"]).alias("text")))
        return T.bind(F.struct(T.bind(spreads, counted).alias("s"), ends.alias("e")), lambda x: F.struct(head.alias("text"), F.struct(
            n.alias("length"), x["e"]["tail"].alias("tail"), x["s"]["chars"].alias("chars"), x["s"]["counts"].alias("counts"),
            x["e"]["words"].alias("words"), depth.alias("depth"), pieces.alias("pieces")).alias("rope")).cast(VALUE))

    return T.bind(total, lambda n: F.when(n <= TEXT, plain(F.array_join(texts, ""))).when(F.size(parts) == 1, F.get(parts, 0)["v"]).otherwise(rope(n)))


def whole(v: Column, kept: Column) -> Column:
    """The text of a value, null beyond ``WHOLE`` characters; ``kept`` has earlier values, the last one first."""
    def opened(pieces: Column, _) -> Column:
        return F.flatten(F.transform(pieces, lambda x: F.when(x["ref"].isNotNull(), F.element_at(kept, F.size(kept) - x["ref"] + 1)["rope"]["pieces"])
                                     .otherwise(F.array(x))))

    rope = v["rope"]
    put = F.array_join(F.transform(F.aggregate(F.sequence(F.lit(1), rope["depth"]), rope["pieces"], opened), lambda x: x["text"]), "")
    return F.when(rope.isNull(), v["text"]).when(rope["length"] <= WHOLE, put)


def of_text(text: Column) -> Column:
    """A text of any length as a value."""
    blocks = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / TEXT).cast("int"))
    return F.when(F.length(text) <= TEXT, plain(text)).when(text.isNotNull(), joined(F.transform(blocks, lambda k: F.struct(
        F.lit(None).cast("int").alias("ref"), plain(F.substring(text, k * TEXT + 1, F.lit(TEXT))).alias("v")))))


def extent(v: Column) -> Column:
    """What the validator needs to know of a rope; null for a text."""
    rope = v["rope"]
    bits = T.bind(F.aggregate(rope["counts"], F.lit(0.0), lambda a, k: a + k), lambda n: F.aggregate(
        rope["counts"], F.lit(0.0), lambda a, k: a - k / n * F.log2(k / n)))
    return F.when(rope.isNotNull(), F.struct(rope["length"].alias("length"), rope["tail"].alias("tail"), bits.alias("entropy"),
                                             F.exists(rope["chars"], lambda c: c.rlike(C.WS)).alias("white"), rope["words"].alias("words")).cast(EXTENT))
