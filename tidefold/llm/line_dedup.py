"""Near-duplicate lines by a segment-partition edit join, in built-in DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import text_of
from tidefold.sources.checkpoints import checkpointed, written

#: Edits (of one code point) up to which two lines count as the same.
EDITS = 2
#: Code points from which a line is compared by edits.
LEAST = 40
#: What a blank line is made of.
_BLANK = " \t\r\x0b\x0c"
#: Lines with a common segment from which on that segment is not enough to compare them one by one: to divide a line
#: anew makes twelve entries with the rest of the line for each of its keys, to compare two lines' letter counts some 30 additions.
HOT = 512


class _Places:
    """A line's place as one number, key * 2 ** bits + its line number, that sorts as (key, line).

    A long where the largest key and text found in the table allow it, else a decimal of 38 digits (any long key
    and any line number fit it): the same results either way.
    """

    def __init__(self, named: DataFrame) -> None:
        bounds = named.agg(F.max("key").alias("most"), F.min("key").alias("least"), F.max(F.octet_length("text")).alias("lines")).first()
        self.bits = max(1, int(bounds["lines"] or 0).bit_length())  # a text has no more lines than bytes, and one
        wide = max(abs(int(bounds["most"] or 0)), abs(int(bounds["least"] or 0)) + 1).bit_length() + self.bits > 62
        if wide:
            self.bits = 32
        self.type = "decimal(38,0)" if wide else "bigint"
        self.unit = f"CAST({1 << self.bits} AS {'decimal(19,0)' if wide else 'bigint'})"

    def of(self, key: str, number: str) -> Column:
        return F.expr(f"CAST({key} * {self.unit} + {number} AS {self.type})")

    def key(self, place: str) -> Column:
        return F.expr(f"CAST(floor(({place} - pmod({place}, {self.unit})) / {self.unit}) AS bigint)" if self.type != "bigint" else f"shiftright({place}, {self.bits})")

    def number(self, place: str) -> Column:
        return F.expr(f"CAST(pmod({place}, {self.unit}) AS int)")


def _segments(length: str, edits: int) -> list[tuple[str, str]]:
    """(start from 1, length) of the edits + 1 segments of a line of that length: the first ones are shorter by one where it doesn't divide."""
    parts = edits + 1
    base, more = f"({length} DIV {parts})", f"({length} % {parts})"
    return [(f"({i} * {base} + greatest(0, {i} - {parts} + {more}) + 1)", f"({base} + IF({i} >= {parts} - {more}, 1, 0))") for i in range(parts)]


def entries(lines: DataFrame, edits: int = EDITS, within: str = "0L", rest: bool = False) -> DataFrame:
    """(key, place, probe) from (place, line): a line's segments, and the substrings with which it probes lines as long or up to `edits` shorter.

    A key is the hash of a segment, its number, the length of the line that owns it, and `within`. Of two lines
    within `edits` edits the longer has the shorter one's segment i, for some i, at a place that the multi-match
    bounds allow: up to i - 1 off its start seen from the left, and up to edits + 1 - i off seen from the right. A
    line's own segments are among its probes for its own length, so `probe` marks the entries that are only probes.
    With `rest` also the line without that segment, and the segment's size: if two lines are within `edits` edits and
    the segment is untouched, so are their rests.
    """
    keys = []
    for shorter in range(edits + 1):
        for i, (start, size) in enumerate(_segments(f"(n - {shorter})", edits)):
            for off in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1):
                # of ASCII lines the bytes, where a place needs no counting
                part = f"IF(ascii, substr(data, {start} + {off}, {size}), CAST(substr(line, {start} + {off}, {size}) AS binary))"
                more = f", concat(substr(line, 1, {start} + {off} - 1), substr(line, {start} + {off} + {size})) AS rest, {size} AS size" if rest else ""
                keys.append(f"struct(xxhash64({i}, n - {shorter}, {part}, {within}) AS key, {'false' if shorter == off == 0 else 'true'} AS probe{more})")
    # places are never null; that Spark knows it keeps filters out of what is dealt by key, so it is dealt once for all uses
    zero = F.lit(0).cast(lines.schema["place"].dataType)
    sized = lines.withColumns({"place": F.coalesce("place", zero), "n": F.length("line"), "data": F.col("line").cast("binary"), "ascii": F.octet_length("line") == F.length("line")})
    return sized.select("place", F.explode(F.expr(f"array({', '.join(keys)})")).alias("e")).select("e.key", "place", *(["e.probe", "e.rest", "e.size"] if rest else ["e.probe"]))


_LETTERS = " abcdefghijklmnopqrstuvwxyz"


def _letters(line: str) -> Column:
    """How often a line has each of some characters."""
    return F.expr(f"array({', '.join(f"length({line}) - length(replace({line}, '{c}', ''))" for c in _LETTERS)})")


def _alike(a: str, b: str, edits: int) -> Column:
    """Whether letter counts allow `edits` edits: each edit moves them by two at most."""
    return F.expr(f"{' + '.join(f'abs({a}[{i}] - {b}[{i}])' for i in range(len(_LETTERS)))} <= {2 * edits}")


def within(a: str, b: str, edits: int = EDITS) -> Column:
    """Whether two columns are at most `edits` edits apart: a banded bit-parallel automaton over the diagonals.

    Bit k of r[e] says that the cell on diagonal k - edits of the current row is reached with e edits; each character
    of b moves all diagonals at once: a match keeps the bit, an edit passes it on to the next level.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    match = " | ".join(f"IF(get(p, i + {k - edits}) = c, {1 << k}, 0)" for k in range(width))
    # levels are built one inside the other, as each needs the new value of the one before
    body = f"named_struct({', '.join(f"'r{e}', x{e}" for e in range(edits + 1))})"
    for e in range(edits, 0, -1):
        body = f"transform(array(((s.r{e} & m) | s.r{e - 1} | shiftright(s.r{e - 1}, 1) | shiftleft(x{e - 1}, 1)) & {full}), x{e} -> {body})[0]"
    body = f"transform(array({match}), m -> transform(array(s.r0 & m), x0 -> {body})[0])[0]"
    start = f"named_struct({', '.join(f"'r{e}', {sum(1 << edits + j for j in range(e + 1))}" for e in range(edits + 1))})"
    walk = f"aggregate(transform(q, (c, i) -> struct(c AS c, i AS i)), {start}, (s, ci) -> transform(array(ci.c), c -> transform(array(ci.i), i -> {body})[0])[0])"
    done = f"transform(array(split({a}, '')), p -> transform(array(split({b}, '')), q -> (shiftright({walk}.r{edits}, size(p) - size(q) + {edits}) & 1) = 1)[0])[0]"
    return F.expr(f"CASE WHEN abs(length({a}) - length({b})) > {edits} THEN false ELSE {done} END")


def _verified(pairs: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """(later): places of lines with an earlier one, of the candidate pairs (earlier, later), within `edits` edits."""
    one = pairs.join(lines.select(F.col("place").alias("earlier"), F.col("line").alias("a"), F.col("letters").alias("la")), "earlier")
    two = one.join(lines.select(F.col("place").alias("later"), F.col("line").alias("b"), F.col("letters").alias("lb")), "later")
    return two.where(_alike("la", "lb", edits)).where(within("a", "b", edits)).select("later").distinct()


def _shared(offered: DataFrame) -> DataFrame:
    """(k, hub, n): keys of more than one place, one of which owns the segment; the first place, and how many entries."""
    # a key may come twice from one place: it is shared only if its first and last place differ
    found = offered.groupBy("key").agg(F.min("place").alias("hub"), F.max("place").alias("last"), F.min("probe").alias("only"), F.count("*").alias("n"))
    return found.where("hub < last AND NOT only").select(F.col("key").alias("k"), "hub", "n")


def _settled(each: DataFrame, lines: DataFrame, decided: DataFrame, edits: int, all_of: str) -> tuple[DataFrame, DataFrame]:
    """(decided, open): entries (key, place, probe, hub, n, letters) against their key's first line, then, of keys for
    which `all_of` holds, what is left against all earlier lines of the key whose letter counts are close enough."""
    star = each.where("place <> hub").select(F.col("hub").alias("earlier"), F.col("place").alias("later")).distinct()
    star = star.join(decided, "later", "left_anti")
    decided = checkpointed(decided.unionAll(_verified(star, lines, edits)).distinct())
    open_ = each.where("place <> hub").join(decided, each["place"] == decided["later"], "left_anti")
    few = open_.where(all_of).select("key", F.col("place").alias("later"), F.col("letters").alias("lb"), F.col("probe").alias("p"))
    other = each.where("place <> hub").where(all_of).select("key", F.col("place").alias("earlier"), F.col("letters").alias("la"), "probe")
    rest = few.join(other, "key").where("earlier < later AND NOT (p AND probe)").where(_alike("la", "lb", edits))
    decided = checkpointed(decided.unionAll(_verified(rest.select("earlier", "later").distinct(), lines, edits)).distinct())
    return decided, open_.where(f"NOT ({all_of})")


def _divided(hot: DataFrame, lines: DataFrame, decided: DataFrame, edits: int, parts: int) -> DataFrame:
    """`decided` and what the keys of many lines add: their lines are joined anew by segments of what the shared one leaves.

    hot: (key) with open entries. Lines of one key that are alike have rests that are alike, so the rests' segments
    divide the key's lines; what is still hot is divided again. Rests shrink by a third each time, and lines whose rests
    have no more than `edits` code points are all alike, which the first line of their key settles.
    """
    members = entries(lines.select("place", "line"), edits, rest=True)
    while not (hot := checkpointed(hot.select("key").distinct())).isEmpty():
        members = written(members.join(hot, "key", "left_semi").where("size > 0").distinct())
        inner = members.select(F.struct("place", "key").alias("place"), F.col("rest").alias("line"))
        parted = entries(inner.withColumn("of", F.col("place.key")).select(F.col("place.place").alias("place"), "line", "of"), edits, within="of", rest=True)
        parted = written(parted.repartition(parts, "key"))
        shared = parted.join(_shared(parted), F.col("key") == F.col("k")).select("key", "place", "probe", "hub", "n", (F.col("size") == 0).alias("bare")).distinct()
        each = shared.join(lines.select("place", "letters"), "place")
        decided, open_ = _settled(each, lines, decided, edits, f"n <= {HOT} OR bare")
        members, hot = parted, open_
    return decided


#: Most numbers (keys and removed lines) that go along with every task; beyond, the texts are dealt to them instead.
_BROADCAST_NUMBERS = 2_000_000


def near_duplicate_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, least: int = LEAST, carry: tuple[str, ...] = (), equal_least: int | None = None) -> DataFrame:
    """(key, text, carried, exact, near, kept): numbers (from 0) of the lines that an equal one, or one within `edits` edits, precedes; the text without them.

    Lines are what line feeds separate. Those of `least` code points and more are compared by edits. Equal ones are
    removed from `equal_least` code points (`least` if None; at 1 whatever their length); blank lines under `least`
    always stay, as they part paragraphs. Order is by key, then place. Equal lines are settled first, by their 128-bit hashes, pre-aggregated, so copies don't reach the join. Entries that
    share a key with another line are kept, and decided in two steps: against the key's first line (linear in the
    key's rows; a group of near copies mostly ends here), then what is left against the earlier lines of the key whose
    letter counts are close enough; a key of over HOT entries is first divided by further segments (see `_divided`),
    so a common head of many lines makes no pairs of them all. Numbers are shuffled, and the texts once; removed line numbers go along with
    every task where both checked counts allow that (_BROADCAST_NUMBERS), else the texts are dealt to them.

    `key` must be an integer. A null text is empty; rows without a key are kept as they are; rows that repeat a key
    count as one document, and a line number removed from it is removed from each; an empty table gives no rows. Any
    key and any number of lines will do. `carried` is a struct of the columns named by `carry`, so their names can't
    clash with others; further columns are not read.
    """
    carried = F.struct(*[docs[c].alias(c) for c in carry]) if carry else F.lit(None).cast("string")
    read = docs.select(docs[key].cast("bigint").alias("key"), text_of(docs, text).alias("text"), carried.alias("carried"))
    named = read.where("key is not null").select("key", "text")
    looked = F.length("line") >= least
    if equal_least is not None and equal_least < least:
        looked = looked | ((F.length("line") >= equal_least) & (F.trim(F.col("line"), F.lit(_BLANK)) != ""))
    lines = named.select("key", F.posexplode(F.split("text", "\n")).alias("n", "line")).where(looked)
    places = _Places(named)
    hashed = lines.select(places.of("key", "n").alias("place"), F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))
    first = hashed.groupBy("h", "g").agg(F.min("place").alias("first"))
    later = hashed.join(first, ["h", "g"]).where("place <> first").select("place")
    exact = checkpointed(later.select(places.key("place").alias("key"), places.number("place").alias("n")).groupBy("key").agg(F.collect_set("n").alias("exact")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = named.repartition(parts, "key")
    # by numbers that are left, and each text split once: linear in a text's lines
    left = "transform(array_except(sequence(0, size(ls) - 1), coalesce(exact, array())), i -> struct(i AS n, ls[i] AS line))"
    distinct = texts.join(exact, "key", "left").select("key", F.explode(F.expr(f"transform(array(split(text, '\\n')), ls -> {left})[0]")).alias("l")).select("key", "l.n", "l.line").where(F.length("line") >= least)
    offered = entries(distinct.select(places.of("key", "n").alias("place"), "line"), edits).repartition(parts, "key")
    shared = offered.join(_shared(offered).hint("shuffle_hash"), F.col("key") == F.col("k")).groupBy("place").agg(F.collect_set(F.struct("key", "probe", "hub", "n")).alias("keys"))
    of_text = shared.groupBy(places.key("place").alias("key")).agg(F.collect_list(F.struct(places.number("place").alias("i"), "place", "keys")).alias("items"))
    named_ = "transform(array(split(text, '\\n')), ls -> transform(items, x -> struct(x.place AS place, x.keys AS keys, get(ls, x.i) AS line)))[0]"
    shared = of_text.join(texts, "key").select(F.explode(F.expr(named_)).alias("l")).select("l.*").where("line is not null")
    lines = written(shared.withColumn("letters", _letters("line")))
    each = lines.select("place", "letters", F.explode("keys").alias("e")).select("place", "letters", "e.*")
    none_yet = lines.select(F.col("place").alias("later")).limit(0)
    decided, open_ = _settled(each, lines, none_yet, edits, f"n <= {HOT}")
    near = _divided(open_, lines, decided, edits, parts)
    near = checkpointed(near.select(places.key("later").alias("key"), places.number("later").alias("n")).groupBy("key").agg(F.collect_set("n").alias("near")))
    gone = exact.join(near, "key", "full_outer")
    numbers = [df.agg(F.count("*") + F.coalesce(F.sum(F.size(c)), F.lit(0))).first()[0] for df, c in ((exact, "exact"), (near, "near"))]
    if sum(numbers) <= _BROADCAST_NUMBERS:
        gone = F.broadcast(gone)
    none = F.array().cast("array<int>")
    out = read.join(gone, "key", "left")
    out = out.select("key", "text", "carried", F.array_sort(F.coalesce("exact", none)).alias("exact"), F.array_sort(F.coalesce("near", none)).alias("near"))
    kept = F.when((F.size("exact") == 0) & (F.size("near") == 0), F.col("text")).otherwise(
        F.expr("transform(array(split(text, '\\n')), ls -> array_join(transform(array_except(sequence(0, size(ls) - 1), concat(exact, near)), i -> ls[i]), '\\n'))[0]")
    )
    return out.withColumn("kept", kept)
