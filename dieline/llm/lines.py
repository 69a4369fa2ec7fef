"""Line deduplication by an exact set-similarity join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, bounded

_SPACES = "\t\x0b\x0c\r"
_WORD = r"[^\x20\x09-\x0D]"
#: A token is 56 bits of its word's hash; the byte above holds its rarity.
_MASK = (1 << 56) - 1
#: Rarities are gathered in rows of 2 ** _ROW hash buckets.
_ROW = 10
#: So many smallest hashes of a set of up to so many tokens, or of a larger one, stand for it where similar pairs are estimated.
_LOW = (5, 24, 8)
_HASHES = ("cid", "p.list.element", "g0", "g1", "key", "h.list.element", "t.list.element", "low", "row", "th", "first.th")
#: A null id comes last.
_LAST = (1 << 63) - 1


def _words(text: Column) -> Column:
    """The lower-cased words of a line between ASCII white space, with empty ones; a split at one character needs no pattern matching."""
    low = F.lower(text)
    odd = text.contains("\t") | text.contains("\x0b") | text.contains("\x0c") | text.contains("\r")
    return F.split(F.when(odd, F.translate(low, _SPACES, " " * len(_SPACES))).otherwise(low), " ")


def _hashes(line: Column) -> Column:
    """The distinct hashes of a line's words, sorted."""
    hashes = F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w)))
    return F.sort_array(F.array_remove(hashes, F.xxhash64(F.lit(""))))


def _up(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b).cast("int")


def _bits(tokens: Column) -> Column:
    """A bitmap of 64 bits by the tokens' hashes."""
    one = F.lit(1).cast("bigint")
    # a shift counts modulo 64
    return F.aggregate(tokens, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", one, F.hash(x))))


def _near(prefix: Column, count: int) -> Column:
    """The smallest hashes of adjacent tokens of a prefix."""
    last = F.size(prefix) - 1
    pairs = F.zip_with(F.slice(prefix, F.lit(1), last), F.slice(prefix, F.lit(2), last), lambda a, b: F.xxhash64(a, b))
    return F.when(F.size(prefix) > 1, F.slice(F.sort_array(pairs), 1, count)).otherwise(F.transform(prefix, lambda x: F.xxhash64(x)))


def _rarity(words: DataFrame, scratch: Scratch, buckets: int, share: int) -> tuple[Column, int]:
    """The rarity of each hash bucket, as a scalar array of bytes, which a CPU's cache holds, and the token that halves all occurrences, by the hashes h of every line, or of one line in share; c lines have the same as one of words."""
    some = words if share == 1 else words.filter(F.pmod(F.xxhash64("at", "th", "pos"), F.lit(share)) == 0)
    seen = some.select("c", F.explode("h").alias("w")).groupBy(F.col("w").bitwiseAND(buckets - 1).cast("int").alias("k")).agg(F.sum("c").alias("count"))
    every = words.sparkSession.range(buckets).select(F.col("id").cast("int").alias("k"), F.lit(0).cast("bigint").alias("count"))
    step = F.least(F.lit(127), F.floor(4 * F.log2(F.col("count") + 1))).cast("tinyint")
    counts = seen.unionByName(every).groupBy("k").agg(F.sum("count").alias("count"))
    steps = scratch.save(counts.select("k", "count", step.alias("c")), "steps")
    mass, half = steps.groupBy("c").agg(F.sum("count").alias("n")).orderBy("c").collect(), 0  # at most 128 rows
    total = sum(x["n"] for x in mass)
    for x in mass:
        half += x["n"]
        if 2 * half >= total:
            break
    rows = steps.groupBy(F.shiftright("k", _ROW).alias("r")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("s"))
    whole = rows.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("r", "s"))), lambda x: x["s"])).alias("rarity"))
    whole = scratch.save(whole, "rarity").scalar()
    scratch.drop("steps")
    return whole, (x["c"] if mass else 0) << 56


def repeated_lines(
    docs: DataFrame,
    scratch: Scratch,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 80,
    buckets: int = 1 << 18,
    near_keys: int = 4,
    dense: int = 64,
    share: int = 1,
) -> DataFrame:
    """Remove each line that an earlier line matches with a Jaccard similarity of percent / 100 or more.

    Lines end at newlines; a line's set holds its distinct words, lower-cased, which ASCII white space separates. Lines are in the order of (document id, position); an earlier line counts whether or not it is removed
    itself. Lines without words never match and stay.

    Equal sets form a class. Tokens are ordered by rarity: by the number of occurrences of their hash
    bucket, once a line, in all lines (or in one line of `share`), in steps of a quarter of a power of two, then by hash; any one order makes the
    filters exact, so this count decides on speed alone, and this order keeps frequent words out of prefixes. Pairs of classes with equal smallest hashes
    tell how many pairs are similar. Where there may be more than classes (as `dense` is 64; in proportion to it), classes that share adjacent tokens
    of their prefixes are first verified against the earliest of these classes, which settles most members of
    large groups with one pair each; fewer pairs are left to what follows. Then classes that share a token of their prefixes, the later of them still
    unmatched, pass the length and the positional filter and a bound on their overlap by two bitmaps, one of the rarer half
    of all occurrences, within the join; what is left passes a bound by whole prefixes and is verified on whole sets, each class against its earliest partner first and against the others if that is no match. Where keys remain with
    `dense` or more meetings and these outnumber the classes, the classes of these keys that pass the filters with another one bring their sets into that join (by a broadcast where they are few), so that it
    passes on links only and not the many pairs of a group that nearly match.

    Cases: a null text is empty and stays null. Rows that repeat both id and text count as one
    document and lose the same lines; rows that repeat an id only are ordered by their texts' hash. Null ids come last.
    A text of any length is split once and carried by none of its lines. Other columns are ignored. An
    table gives an empty result. Of the tables in scratch only the result is left.

    Returns at (the id, null as the largest number), th (xxhash64 of the text), removed (ascending
    line numbers from 0): one row for each document that loses lines.
    """
    plain = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("at"), F.col(text_col).cast("string").alias("text"))

    each = plain.select("at", F.xxhash64("text").alias("th"), F.split("text", "\n").alias("all")).select("at", "th", F.posexplode("all").alias("pos", "line"))
    cid = F.xxhash64("h").alias("cid")
    each = each.select("at", "th", "pos", _hashes(F.col("line")).alias("h"))
    words = scratch.save(each.select(F.monotonically_increasing_id().alias("row"), "at", "th", "pos", cid, "h"), "words", hashes=_HASHES)
    words = words.filter(F.size("h") > 0)

    # one row per distinct set, with its first line; only repeated sets are gathered, and only first lines get their tokens in order
    again = bounded(scratch.save(words.groupBy("cid").count().filter("count > 1").select("cid"), "again"))
    places = scratch.save(words.select("at", "th", "pos", "row", "cid").join(again, "cid"), "places", hashes=_HASHES)
    firsts = places.groupBy("cid").agg(F.min(F.struct("at", "th", "pos", "row")).alias("least"), F.count("*").alias("c"))
    firsts = bounded(scratch.save(firsts.select("cid", F.col("least.row").alias("one"), "c"), "firsts"))
    lines = words.join(firsts, "cid", "left").filter("one IS NULL OR one = row").select("cid", "at", "th", "pos", F.coalesce("c", F.lit(1)).alias("c"), "h")
    rarity, half = _rarity(lines, scratch, buckets, share)

    def sets(lines: DataFrame) -> DataFrame:
        """t0, the sorted tokens of each line's hashes, with the half mark among them. A written table may hold nulls by its type; its lambda's type has none, so numbers are sorted as such, not as objects."""
        # the subquery goes by a column, as none is allowed in a lambda; the optimizer then puts it there
        lines = lines.withColumn("rarity", rarity)

        def code(h: Column) -> Column:
            step = F.get("rarity", h.bitwiseAND(buckets - 1).cast("int")).cast("bigint")
            return F.coalesce(F.shiftleft(step, 56).bitwiseOR(h.bitwiseAND(F.lit(_MASK))), F.lit(0).cast("bigint"))

        mark = F.array(F.lit(half).cast("bigint"))
        return lines.withColumn("t0", F.sort_array(F.concat(F.transform("h", code), mark))).drop("h", "rarity")

    def parts(lines: DataFrame) -> DataFrame:
        """t, the tokens in order, with the rarer and the more frequent ones apart."""
        lines = lines.withColumn("k", F.array_position("t0", F.lit(half).cast("bigint")).cast("int"))
        lines = lines.withColumn("rare", F.slice("t0", F.lit(1), F.col("k") - 1)).withColumn("often", F.slice("t0", F.col("k") + 1, F.size("t0")))
        return lines.withColumn("t", F.concat("rare", "often")).drop("t0", "k")

    n = F.size("t")
    joins = (n > 3) if percent >= 80 else F.lit(True)
    prefix = F.when(joins, F.slice("t", F.lit(1), n - _up(n * percent, 100) + 1))
    low = F.xxhash64(F.slice("h", F.lit(1), F.when(F.size("h") <= _LOW[1], _LOW[0]).otherwise(_LOW[2]))).alias("low")
    classes = parts(sets(lines.select("cid", F.struct("at", "th", "pos").alias("first"), "c", low, "h"))).select(
        "cid", "first", "c", "low", n.alias("n"), prefix.alias("p"), F.when(joins, _bits(F.col("rare"))).alias("g0"), F.when(joins, _bits(F.col("often"))).alias("g1")
    )
    classes = scratch.save(classes, "classes", hashes=_HASHES)
    scratch.drop("words", "again", "firsts")
    place = classes.select("cid", "first")

    def similar(x: str, y: str, a: Column, b: Column) -> Column:
        """Whether bitmaps and sizes of x and y let them share enough tokens; no similar pair is lost."""
        own = [sum(F.bit_count(F.col(f"{p}{g}").bitwiseAND(F.bitwise_not(f"{q}{g}"))) for g in ("g0", "g1")) for p, q in ((x, y), (y, x))]
        return F.least(a - own[0], b - own[1]) * (100 + percent) >= (a + b) * percent

    def alike(p: Column, q: Column, a: Column, b: Column) -> Column:
        """Whether prefixes let sets of a and b tokens share enough: of the prefix that ends first, what the other lacks is in no part of the other's set."""
        ends = F.element_at(p, -1) <= F.element_at(q, -1)
        rest = F.when(ends, a - F.size(p)).otherwise(b - F.size(q)) + F.size(F.array_intersect(p, q))
        return rest * (100 + percent) >= (a + b) * percent

    def fetched(ids: DataFrame, name: str) -> DataFrame:
        """cid, first and t, the hashes of all words, of each of these classes, of its first line; only documents that have some are split again."""
        ids = bounded(scratch.save(ids, f"{name}_cids"))
        ids = scratch.save(place.join(ids, "cid").select("first.*"), f"{name}_ids")
        there = bounded(scratch.save(ids.groupBy("at", "th").agg(F.collect_set("pos").alias("wanted")), f"{name}_there"))
        mine = plain.select("at", F.xxhash64("text").alias("th"), "text").join(there, ["at", "th"])
        mine = mine.select("at", "th", "wanted", F.split("text", "\n").alias("all"))
        mine = mine.select("at", "th", F.explode(F.transform("wanted", lambda i: F.struct(i.alias("pos"), F.get("all", i).alias("line")))).alias("x"))
        whole = mine.select(F.struct("at", "th", "x.pos").alias("first"), _hashes(F.col("x.line")).alias("h"))
        whole = whole.select(cid, "first", F.col("h").alias("t")).dropDuplicates(["cid"])
        whole = scratch.save(whole, f"{name}_sets", hashes=_HASHES)
        scratch.drop(f"{name}_cids", f"{name}_ids", f"{name}_there")
        return whole

    each = F.explode(F.array("a", "b")).alias("cid")

    def promising(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) of a written table that pass the bound by whole prefixes."""
        ids = bounded(scratch.save(pairs.select(each).distinct(), f"{name}_met"))
        some = scratch.save(classes.select("cid", "n", "p").join(ids, "cid"), f"{name}_prefixes")
        x, y = (some.select(F.col("cid").alias(c), F.struct("n", "p").alias(s)) for c, s in (("a", "x"), ("b", "y")))
        pairs = scratch.save(x.join(bounded(pairs), "a").join(y, "b").filter(alike(*map(F.col, ("x.p", "y.p", "x.n", "y.n")))).select("a", "b"), f"{name}_alike")
        scratch.drop(f"{name}_met", f"{name}_prefixes")
        return pairs

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The later class of each linked pair (a, b) of a written table."""
        whole = fetched(pairs.select(each).distinct(), name)
        a = whole.select(F.col("cid").alias("a"), F.col("t").alias("x"), F.col("first").alias("fx"))
        b = whole.select(F.col("cid").alias("b"), F.col("t").alias("y"), F.col("first").alias("fy"))
        both = F.size(F.array_intersect("x", "y"))
        found = a.join(bounded(pairs), "a").join(b, "b").filter(both * (100 + percent) >= (F.size("x") + F.size("y")) * percent)
        later = F.when(F.col("fx") > F.col("fy"), F.col("a")).otherwise(F.col("b"))
        found = scratch.save(found.select(later.alias("cid")).distinct(), name)
        scratch.drop(f"{name}_sets")
        return found

    longer = classes.filter(F.size("p") > 0)
    marks = classes.select("cid", "n", "g0", "g1")

    def stars() -> tuple[DataFrame, DataFrame]:
        """The star of each key that classes share: its classes against the earliest of them. Returns the keys and the later class of each linked pair."""
        keys = scratch.save(longer.select("cid", F.col("first.at").alias("at"), F.explode(_near(F.col("p"), near_keys)).alias("key")), "keys", hashes=_HASHES)
        many = scratch.save(keys.groupBy("key").count().filter("count > 1").select("key"), "many")
        keys = scratch.save(keys.join(bounded(many), "key"), "shared")
        scratch.drop("keys", "many")
        top = scratch.save(keys.groupBy("key").agg(F.min(F.struct("at", "cid")).alias("y")).select("key", F.col("y.cid").alias("b")), "top")
        pairs = keys.join(bounded(top), "key").filter("cid <> b").select(F.col("cid").alias("a"), "b").distinct()
        pairs = bounded(scratch.save(pairs, "all"))
        pairs = marks.select(F.struct(*marks.columns).alias("y")).join(pairs, F.col("y.cid") == F.col("b"))
        pairs = bounded(scratch.save(pairs.select("a", "y"), "half"))
        pairs = marks.select(F.struct(*marks.columns).alias("x")).join(pairs, F.col("x.cid") == F.col("a"))
        pairs = pairs.filter(similar("x.", "y.", F.col("x.n"), F.col("y.n"))).select("a", F.col("y.cid").alias("b"))
        late = verified(promising(scratch.save(pairs, "stars"), "near"), "near")
        scratch.drop("top", "all", "half", "stars", "near_alike")
        return keys, late

    def candidates(classes: DataFrame, more: list[str]) -> DataFrame:
        """Pairs that share a prefix token and pass the filters, as x_... and y_... for cid and more.

        Rows are flat and packed, and both sides are the same rows: they are shuffled once.
        """
        packed = (F.shiftleft(F.col("n").cast("bigint"), 32) + F.shiftleft(F.col("i").cast("bigint"), 1) + F.col("open")).alias("w")
        rows = classes.select("cid", F.col("first.at").alias("at"), "n", "open", "g0", "g1", *more, F.posexplode("p").alias("i", "token"))
        rows = rows.select("token", "cid", "at", packed, "g0", "g1", *more)
        for c in rows.columns:  # there are no nulls, but the join would ask for that on one side alone
            rows = rows.filter(F.col(c).isNotNull())
        rows = rows.repartition("token")
        v, w = F.col("x_w"), F.col("y_w")
        a, b = F.shiftright(v, 32), F.shiftright(w, 32)
        i, j = (F.shiftright(z.bitwiseAND(F.lit((1 << 32) - 1)), 1) for z in (v, w))
        other = rows.select("token", *(F.col(c).alias(f"y_{c}") for c in rows.columns[1:]))
        pairs = rows.select("token", *(F.col(c).alias(f"x_{c}") for c in rows.columns[1:]))
        # the class of fewer tokens meets others by a shorter prefix; the number, which is never negative, keeps this filter above the shuffle, so that it stays one for both sides
        pairs = pairs.filter(F.when(F.monotonically_increasing_id() >= 0, (a - i) * (100 + percent) >= a * (2 * percent))).join(other, "token")
        # each pair in one order, the class of fewer tokens first
        once = (a < b) | ((a == b) & (F.col("x_cid") < F.col("y_cid")))
        length = a * 100 >= b * percent
        # at most this many are shared if this is the first token that both have
        position = F.least(a - i, b - j) * (100 + percent) >= (a + b) * percent
        # the later one is open
        useful = ((v % 2 == 1) & (F.col("x_at") >= F.col("y_at"))) | ((w % 2 == 1) & (F.col("y_at") >= F.col("x_at"))) if late is not None else F.lit(True)
        return pairs.filter(length & once & position & useful & similar("x_", "y_", a, b))

    # a pair shares its smallest hashes with a probability of its similarity to the power of their number, or by chance: so this estimates similar pairs
    m = F.col("m").cast("double")
    like = longer.groupBy("low").agg(F.count("*").alias("m")).agg(F.sum(m * (m - 1))).first()[0] or 0
    late, hot, state = None, False, longer.withColumn("open", F.lit(1))
    if 64 * like >= dense * classes.count():
        # where open classes of a few keys would meet more classes than there are, sets go into the join, which passes on links alone
        keys, late = stars()
        state = longer.join(bounded(late.withColumn("done", F.lit(True))), "cid", "left").withColumn("open", F.when(F.col("done").isNull(), 1).otherwise(0))
        met = keys.join(bounded(late.withColumn("done", F.lit(1))), "cid", "left").groupBy("key").agg(F.count("*").alias("m"), F.count_if(F.col("done").isNull()).alias("o"))
        met = scratch.save(met.filter(F.col("m") * F.col("o") >= dense).select("key", (F.col("m") * F.col("o")).alias("met")), "met")
        hot = (met.agg(F.sum("met")).first()[0] or 0) >= (classes.count() if dense else 1)
    if hot:
        # most words meet by chance: only classes of which a pair passes the filters
        some = bounded(scratch.save(keys.join(bounded(met.select("key")), "key").select("key", "cid"), "dense"))
        some = scratch.save(state.select(*marks.columns, "p", "open").join(some, "cid"), "dense_marks")
        x, y = (some.select(*(F.col(c).alias(f"{s}_{c}") for c in some.columns)) for s in "xy")
        a, b = F.col("x_n"), F.col("y_n")
        useful = (F.col("x_cid") != F.col("y_cid")) & (F.col("x_open") + F.col("y_open") > 0) & (F.least(a, b) * 100 >= F.greatest(a, b) * percent)
        passed = x.join(y, (F.col("x_key") == F.col("y_key")) & useful & similar("x_", "y_", a, b) & alike(F.col("x_p"), F.col("y_p"), a, b), "left_semi")
        thick = scratch.save(passed.select(F.col("x_cid").alias("cid")).distinct(), "thick")
        scratch.drop("dense", "dense_marks")
        hot = not thick.isEmpty()
    if hot:
        whole = fetched(thick, "thick").select("cid", "first", "t")
        both = F.size(F.array_intersect("x_t", "y_t"))
        dense_state = state.join(bounded(thick), "cid")
        if (sent := bounded(whole)) is not whole:  # small sets go to the pairs, larger ones into the rows
            linked = candidates(dense_state, [])
            for z in "xy":
                linked = linked.join(sent.select(*(F.col(c).alias(f"{z}_{c}") for c in whole.columns)), f"{z}_cid")
        else:
            linked = candidates(whole.select("cid", "t").join(dense_state, "cid"), ["first", "t"])
        linked = linked.filter(both * (100 + percent) >= (F.size("x_t") + F.size("y_t")) * percent)
        found = linked.select(F.when(F.col("x_first") > F.col("y_first"), F.col("x_cid")).otherwise(F.col("y_cid")).alias("cid")).distinct()
        late = scratch.save(late.unionByName(found).distinct(), "late_thick")
        scratch.drop("thick_sets")
        state = state.join(bounded(thick.withColumn("thick", F.lit(1))), "cid", "left").withColumn("thick", F.coalesce("thick", F.lit(0)))

    scratch.drop("shared", "met")
    pairs = candidates(state, ["thick"] if hot else [])
    pairs = pairs.filter(F.col("x_thick") + F.col("y_thick") < 2) if hot else pairs
    # each class against its earliest partner first, which settles most; then what is left, and pairs within a document, of which either may be the later one
    x, y = F.struct(F.col("x_at").alias("at"), F.col("x_cid").alias("cid")), F.struct(F.col("y_at").alias("at"), F.col("y_cid").alias("cid"))
    wide = pairs.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    wide = wide.select(F.col("a.cid").alias("a"), F.col("b.cid").alias("b"), F.col("b.at").alias("at"), (F.col("a.at") == F.col("b.at")).alias("tie"))
    wide = scratch.save(wide.distinct(), "far_pairs")
    one = wide.groupBy("a").agg(F.min(F.struct("at", "b")).alias("y")).select("a", F.col("y.b").alias("b"))
    one = verified(promising(scratch.save(one, "far_ones"), "one"), "one")
    rest = wide.join(bounded(one.select(F.col("cid").alias("a"), F.lit(True).alias("done"))), "a", "left").filter("done IS NULL OR tie")
    far = verified(promising(scratch.save(rest.select("a", "b"), "far_rest"), "far"), "far")

    far = far.unionByName(one)
    late = far.distinct() if late is None else late.unionByName(far).distinct()
    late = bounded(scratch.save(late, "all_late")).withColumn("late", F.lit(True))
    late = scratch.save(classes.join(late, "cid", "left").filter("c > 1 OR late").select("cid", "first", "c", F.coalesce("late", F.lit(False)).alias("late")), "late")
    own = F.struct("at", "th", "pos") == F.col("first")
    gone = places.join(bounded(late.filter("c > 1")), "cid").filter(F.col("late") | ~own).select("at", "th", "pos")
    gone = gone.unionByName(late.filter("c = 1").select("first.*"))
    gone = gone.groupBy("at", "th").agg(F.sort_array(F.collect_set("pos")).alias("removed"))
    gone = scratch.save(gone, "gone")
    scratch.drop("rarity", "places", "classes", "near", "thick", "late_thick", "far_pairs", "far_ones", "one_alike", "one", "far_rest", "far_alike", "far", "all_late", "late")
    return gone


def _rest(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row as the struct row, its line numbers to remove, and what is left of its text."""
    text = F.col(text_col).cast("string")
    at = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("at")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), at, F.xxhash64(text).alias("th"), text.alias("text"))
    rows = rows.join(bounded(gone), ["at", "th"], "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    rows = rows.withColumn("all", F.split(F.coalesce("text", F.lit("")), "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), "removed")
    left = F.when(F.size("removed") > 0, F.array_join(F.transform(stay, lambda i: F.get("all", i)), "\n")).otherwise(F.col("text"))
    return rows.select("row", "removed", F.size("all").alias("n_lines"), left.alias("left"))


def line_dedup(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """What repeated_lines() removes from each document.

    Returns doc_id, n_lines, n_removed, removed, text (the rest): one row per input row.
    """
    found = _rest(docs, repeated_lines(docs, scratch, id_col, text_col, **options), id_col, text_col)
    return found.select(
        F.col(f"row.{id_col}").cast("bigint").alias("doc_id"), "n_lines", F.size("removed").alias("n_removed"), "removed", F.col("left").alias("text")
    )


def _once(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """docs with one row of those that repeat both id and text, if that has words. Which rows stay is decided as they are read, so it needs no numbers that hold."""
    text = F.col(text_col).cast("string")
    keys = (F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("at"), F.xxhash64(text).alias("th"))
    again = docs.filter(text.rlike(_WORD)).select(*keys).groupBy("at", "th").count().filter("count > 1").select("at", "th")
    again = scratch.save(again, "copies")
    if again.isEmpty():
        return docs
    rows = docs.select(*keys, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    copies = rows.join(bounded(again), ["at", "th"]).withColumn("k", F.monotonically_increasing_id())
    copies = copies.withColumn("k", F.row_number().over(Window.partitionBy("at", "th").orderBy("k"))).filter("k = 1")
    rows = rows.join(bounded(again), ["at", "th"], "left_anti").select("row").unionByName(copies.select("row"))
    return rows.select(*(F.col(f"row.`{c}`") for c in docs.columns))


def without_repeated_lines(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with all their columns, without the lines that repeated_lines() finds.

    A document that had words and of which no line with words is left goes; so does a row with words that repeats another one's id and text, as all its lines are that one's.
    """
    gone = repeated_lines(docs, scratch, id_col, text_col, **options)
    found = _rest(_once(docs, scratch, id_col, text_col), gone, id_col, text_col)
    found = found.filter((F.size("removed") == 0) | F.col("left").rlike(_WORD))
    return found.select(*(F.col("left").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))
