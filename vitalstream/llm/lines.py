"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Lines are compared by their words, in lower case. Lines with a word that repeat
exactly are found by hash; lines of NEAR_WORDS or more are also compared within
an edit bound of one word, so four of five words or more agree. For that a line emits the
variants that lack one of its words, as hashed keys:

* two lines of equal length are one replacement apart if they share a variant
  that lacks the same place, so each key's group needs its earliest line only;
* a line is one insertion from another if it equals one of its variants.

No group is expanded into pairs: a key has one earliest member, and the pair of
a line and that member is verified word by word.

Only lines that can have a near line emit variants. One edit leaves the first
or the last half of a line as it was, so a line whose halves occur nowhere else
is left out before any variant is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

MIN_WORDS, NEAR_WORDS = 1, 5
#: Hash slots of documents: a filter of at most so many numbers is broadcast.
SLOTS = 1 << 20
_LAST = (1 << 63) - 1


def _norm(line: Column) -> Column:
    """Lower case, single spaces. Few lines need the pattern, and bytes show which."""
    odd = line.contains("  ")
    for c in "\t\x0b\x0c\r":
        odd = odd | line.contains(c)
    return F.trim(F.lower(F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line)))


def _count(norm: Column) -> Column:
    return F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(" "), F.lit(""))) + 1


def _half(less: int) -> str:
    """SQL of a length at most half of w - ``less``, from 1 and 1.5 times powers of two: near lines have one in common."""
    x = f"cast(floor((w - {less}) / 2) as double)"
    p = f"pow(2.0, floor(log2({x})))"
    return f"cast(if({x} >= 1.5 * {p}, 1.5 * {p}, {p}) as int)"


def _without(words: Column, place: Column) -> Column:
    return F.concat(F.slice(words, 1, place - 1), F.slice(words, place + 1, F.size(words)))


def deduplicate_lines(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text without repeated lines, n_lines, n_exact, n_near, n_bytes and ``carry``, for each row of ``docs``.

    n_bytes is the length of the text before. Lines end at a line feed. In the order of doc_id (null last), text hash and
    place, a line goes if an equal line stands earlier, or if its earliest
    equal stands after a line within one word of it; both are judged on the
    input. Lines under NEAR_WORDS words, of which one word is a quarter or more,
    go on exact repeats only; a text without spaces is one word. Blank lines always stay. A null text stays null and has no lines; a text all of
    whose lines go becomes empty. Rows equal in doc_id and text count as one
    document, and each is returned. An empty table gives an empty result.

    Each line crosses the shuffle as hashes; whole texts cross it once, for the
    two joins that need them. A hot line or variant is a partial aggregate.
    """
    base = docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("k1"),
        F.xxhash64(F.col("text").cast("string")).alias("k2"),
        F.col("text").cast("string").alias("text"),
        F.struct("doc_id", *carry).alias("carried"),
    )
    # scanned for hashes: texts stay where they are
    said = base.select("k1", "k2", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("k1", "k2", "pos", _norm(F.col("line")).alias("norm"))
    said = said.withColumn("w", _count(F.col("norm"))).where((F.col("w") >= MIN_WORDS) & (F.col("norm") != ""))
    at = F.struct("k1", "k2", "pos")
    cut = said.withColumn("c0", F.expr(f"if(w >= {NEAR_WORDS}, {_half(0)}, null)")).withColumn("c1", F.expr(f"if(w >= {NEAR_WORDS} and {_half(1)} <> {_half(0)}, {_half(1)}, null)"))
    halves = [F.expr(f"if(c{k} is null, null, xxhash64(c{k}, {sign}, substring_index(norm, ' ', {sign} * c{k})))").alias(f"half{k}{side}") for k in (0, 1) for side, sign in (("a", 1), ("b", -1))]
    names = ["half0a", "half0b", "half1a", "half1b"]
    # hashes of every line, kept: the texts are split and hashed this once
    seen = stored(cut.select(at.alias("at"), "w", "c0", "c1", F.xxhash64("norm").alias("h"), *halves))
    classes = stored(seen.groupBy("h", "w").agg(F.min("at").alias("first"), F.count("*").alias("n"), *(F.min(c).alias(c) for c in ("c0", "c1", *names))))

    # lines that could have a near line: one of their halves occurs in another distinct line
    sides = F.array(*(F.struct(F.col(f"half{k}{s}").alias("half"), F.lit(s).alias("side"), F.col(f"c{k}").alias("c")) for k in (0, 1) for s in "ab"))
    keyed = classes.where("c0 IS NOT NULL").select("h", "w", F.explode(sides).alias("x")).where("x.half IS NOT NULL").select("h", "w", "x.half", "x.side", "x.c")
    shared = keyed.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    # the other half of such a line is where its one edit can be
    maybe = keyed.join(shared, "half", "left_semi").groupBy("h", "w").agg(F.min(F.when(F.col("side") == "a", F.col("c"))).alias("head"), F.min(F.when(F.col("side") == "b", F.col("c"))).alias("tail"))
    maybe = maybe.join(classes.select("h", "w", "first"), ["h", "w"])
    picked = stored(maybe.groupBy(F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2")).agg(F.collect_list(F.struct(F.col("first.pos").alias("pos"), "head", "tail")).alias("want")))
    # of the documents, only those in a slot of one with such a line are shuffled: SLOTS numbers at most
    slot = lambda: F.pmod(F.xxhash64("k1", "k2"), F.lit(SLOTS)).alias("slot")
    some = base.select("k1", "k2", "text", slot()).join(F.broadcast(picked.select(slot()).distinct()), "slot", "left_semi").select("k1", "k2", F.split("text", "\n").alias("lines"))
    near = some.join(picked, ["k1", "k2"]).select("k1", "k2", "lines", F.explode("want").alias("x"))
    near = near.select(
        F.xxhash64("k1", "k2", "x.pos").alias("id"), F.struct("k1", "k2", F.col("x.pos").alias("pos")).alias("first"), "x.head", "x.tail",
        F.split(_norm(F.get(F.col("lines"), F.col("x.pos"))), " ").alias("words"),
    )
    near = stored(near.dropDuplicates(["id"]))

    size = F.size("words")
    places = F.filter(F.sequence(F.lit(1), size), lambda j: F.coalesce(j > F.col("head"), F.lit(False)) | F.coalesce(j <= size - F.col("tail"), F.lit(False)))
    key = lambda left, right: F.xxhash64(F.concat_ws(" ", left, right))
    lacking = near.select("id", "words", F.explode(places).alias("place"))
    lacking = lacking.select(key(F.slice("words", F.lit(1), F.col("place") - 1), F.slice("words", F.col("place") + 1, F.size("words"))).alias("key"), "id", "place")
    own = near.select(key(F.col("words"), F.array().cast("array<string>")).alias("key"), "id", F.lit(0).alias("place"))
    offered = stored(lacking.unionByName(own))
    met = offered.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    meeting = stored(offered.join(met, "key").join(near.select("id", "first"), "id").select("key", "place", F.struct("first", "id").alias("who")))

    # same place: one replacement apart; a whole line and a variant: one insertion apart
    replaced = meeting.where("place > 0").groupBy("key", "place").agg(F.min("who").alias("other"))
    replaced = meeting.join(replaced, ["key", "place"]).where("other < who").select("who", "other", "place", F.col("place").alias("other_place"))
    whole_line = meeting.where("place = 0").groupBy("key").agg(F.min("who").alias("other"))
    longer = meeting.where("place > 0").join(whole_line, "key").where("other < who").select("who", "other", "place", F.lit(0).alias("other_place"))
    variant = meeting.where("place > 0").groupBy("key").agg(F.min(F.struct("who", "place")).alias("o"))
    shorter = meeting.where("place = 0").join(variant, "key").select("who", F.col("o.who").alias("other"), "place", F.col("o.place").alias("other_place")).where("other < who")
    pairs = replaced.unionByName(longer).unionByName(shorter).select(F.col("who.id").alias("id"), F.col("who.first").alias("first"), F.col("other.id").alias("other"), "place", "other_place").distinct()
    checked = pairs.join(near.select("id", "words"), "id").join(near.select(F.col("id").alias("other"), F.col("words").alias("others")), "other")
    left = lambda words, place: F.when(F.col(place) == 0, F.col(words)).otherwise(_without(F.col(words), F.col(place)))
    close = checked.where(left("words", "place") == left("others", "other_place")).select("first").distinct()

    whole = base.select("doc_id", "k1", "k2", "carried", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.split("text", "\n").alias("lines"))
    repeated = classes.where("n > 1").select("h", "w", "first")
    exact = seen.select("at", "h", "w").join(repeated, ["h", "w"]).where("at > first").select("at", F.lit(False).alias("near"))
    gone = exact.unionByName(close.select(F.col("first").alias("at"), F.lit(True).alias("near")))
    gone = gone.groupBy(F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2")).agg(
        F.array_distinct(F.collect_list(F.when(~F.col("near"), F.col("at.pos")))).alias("same"), F.collect_set(F.when(F.col("near"), F.col("at.pos"))).alias("like")
    )
    out = whole.join(gone, ["k1", "k2"], "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.array_union("same", "like"))
    text = F.when(F.col("same").isNull(), F.concat_ws("\n", "lines")).otherwise(F.concat_ws("\n", F.transform(kept, lambda i: F.get(F.col("lines"), i))))
    return out.select(
        "doc_id", F.when(F.col("lines").isNotNull(), text).alias("text"), F.coalesce(F.when(F.col("lines").isNotNull(), F.size("lines")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("same"), F.lit(0)).cast("long").alias("n_exact"), F.coalesce(F.size("like"), F.lit(0)).cast("long").alias("n_near"), "n_bytes", *(F.col(f"carried.{c}").alias(c) for c in carry),
    )

