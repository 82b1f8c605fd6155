"""Near-duplicate strings, found without comparing every pair.

Levenshtein: two strings qualify when ``1 - distance / longer length`` reaches the
threshold, so the distance may be at most ``d = floor((1 - t) * longer length)``.
Work is on distinct values. Candidates come from two exact filters, chosen by
the longer length of the pair:

* ``d <= 2``: deleting up to ``d`` characters on both sides must meet in a common
  string (deletion neighbourhoods). Long shared prefixes do not create candidates.
* ``d >= 3``: cut the shorter string into so many pieces that one of them carries
  at most one edit; it meets a stretch of the longer string after one deletion on
  both sides. Pieces are twice as long as whole ones could be, so common words
  and prefixes rarely make candidates.
* ``d >= 3`` and more than ``LONG`` characters: an inverted index over q-grams. An edit
  destroys at most q grams, so of the ``q d + 1`` rarest grams of both strings one is
  common, at places at most ``d`` apart. Keys grow with the length only, and those
  that no second place has are dropped.

Every candidate is verified with the exact similarity before it is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions.relations import match_keys, sum_where
from veritab.model import Check, TablePlan

# Deleting more than two characters gives too many variants per value.
MAX_DELETIONS = 2

# Longer strings are looked up by their rare q-grams. Grams are as long as lets the rare ones
# be about ``GRAM_SHARE`` of all; thresholds below LEAST_FOR_GRAMS would leave one character.
LONG = 64
GRAM_SHARE, LONGEST_GRAM, LEAST_FOR_GRAMS = 0.6, 16, 0.7
# Strings are cut into stretches first, longer ones of very long strings: taking a gram out of a string
# counts from its begin, as does taking a stretch.
STRETCH = 64


def _allowed(length: Column, threshold: float) -> Column:
    """Edits allowed when the longer string has ``length`` characters."""
    return F.floor(length * F.lit(1.0 - threshold) + F.lit(1e-9)).cast("int")


def _longest_partner(length: Column, threshold: float) -> Column:
    return F.floor(length / F.lit(threshold) + F.lit(1e-9)).cast("int")


def _without(text: Column, p: Column, q: Column) -> Column:
    """The text without its one-based places ``p < q``; 0 deletes nothing."""
    return F.concat(F.substring(text, F.lit(1), p - 1), F.substring(text, p + 1, q - p - 1),
                    F.substring(text, q + 1, F.length(text)))


def _meet(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs with a common key.

    Keys are many times the strings they come from, which size estimates do not
    see, so the join is shuffled whatever the estimate says.
    """
    return left.hint("merge").join(right, "k")


def _by_deletion(values: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs whose longer string allows one or two edits."""
    size = F.length("v")
    # A value may pair with a longer partner that allows more edits than itself.
    reach = F.least(_allowed(_longest_partner(size, threshold), threshold),
                    F.lit(MAX_DELETIONS))
    rows = values.where((_allowed(size, threshold) <= MAX_DELETIONS) & (reach >= 1))
    p, q = F.col("p"), F.col("q")
    first = F.explode(F.sequence(F.lit(0), F.when(reach == 2, size - 1).otherwise(0)))
    rows = rows.where(size > 0).select("v", first.alias("p"))
    rows = rows.select("v", "p", F.explode(F.sequence(
        F.when(p == 0, F.lit(0)).otherwise(p + 1), size)).alias("q"))
    # A hash collision only adds a candidate, and candidates are verified.
    keys = rows.select("v", F.xxhash64(_without(F.col("v"), p, q)).alias("k"))
    left, right = keys.withColumnRenamed("v", "a"), keys.withColumnRenamed("v", "b")
    gap = F.abs(F.length("a") - F.length("b"))
    possible = (F.col("a") < F.col("b")) & (
        gap <= _allowed(F.greatest(F.length("a"), F.length("b")), threshold))
    return _meet(left, right).select("a", "b", possible.alias("possible"))


def _piece_start(size: Column, pieces: Column, i: Column) -> Column:
    """Zero-based start of piece ``i`` (even cut; the remainder goes to the last pieces)."""
    base = F.floor(size / pieces)
    longer = size - base * pieces
    return i * base + F.greatest(i - (pieces - longer), F.lit(0))


def _pieces(edits: Column) -> Column:
    """So many pieces that one of them has at most one of the edits."""
    return F.floor(edits / 2) + 1


def _piece_keys(df: DataFrame, start: Column, width: Column, grown: Column | None) -> DataFrame:
    """Key rows such that two stretches at most one edit apart have a key in common.

    Equal stretches meet as wholes; an insertion meets a whole with one character
    deleted on the other side; a substitution meets with the same place deleted on
    both. ``gone`` is the character a substitution deleted: it has to differ, or
    equal stretches would meet again at every place.

    ``grown`` is how much longer the stretch is than the piece it is compared
    with; without it ``df`` holds the pieces themselves.
    """
    text = F.substring(F.col("v"), (start + 1).cast("int"), width.cast("int"))
    kept = [] if grown is None else [grown.alias("grown")]
    cut = df.select("v", "shorter", "g", "i", text.alias("text"), *kept)
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.length("text"))).alias("q"))
    q = F.col("q")
    if grown is None:
        kinds = F.when(q == 0, F.array(F.lit("whole"))).otherwise(F.array(F.lit("less"), F.lit("same place")))
    else:
        kinds = (F.when((F.col("grown") == 0) & (q == 0), F.array(F.lit("whole")))
                 .when(F.col("grown") == 0, F.array(F.lit("same place")))
                 .when((F.col("grown") == 1) & (q > 0), F.array(F.lit("whole")))
                 .when((F.col("grown") == -1) & (q == 0), F.array(F.lit("less"))))
    cut = cut.select("*", F.explode(kinds).alias("kind"))
    swapped = F.col("kind") == "same place"
    left = _without(F.col("text"), F.lit(0), q)
    return cut.select(
        "v", F.xxhash64("shorter", "g", "i", "kind", F.when(swapped, q).otherwise(0), left).alias("k"),
        F.when(swapped, F.substring(F.col("text"), q, F.lit(1))).alias("gone"))


def _gram_length(threshold: float) -> int:
    spare = max(1.0 - threshold, 1e-6)
    return max(2, min(LONGEST_GRAM, int(GRAM_SHARE / spare + 1e-9)))


def rare_grams(values: DataFrame, threshold: float) -> DataFrame:
    """The q-grams that decide about a string: ``id, n, g, p, rank``, the rarest first.

    A string has as many ranks as its longest partner's edits can destroy, and one; of those
    only grams that occur at another place too are rows. ``id`` is the string's digest.
    """
    q = _gram_length(threshold)
    size = F.length("v")
    reach = _allowed(_longest_partner(size, threshold), threshold)
    stretch = F.greatest(F.lit(STRETCH), F.sqrt(size).cast("int"))
    strings = _maybe_long(values, threshold).select(
        F.unhex(F.md5("v")).alias("id"), size.alias("n"), (reach * q + 1).alias("most"), stretch.alias("stretch"), "v")
    at = F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.col("stretch")))
    cut = strings.where("n > 0").select("id", "n", "most", "stretch", "v", at.alias("at")).select(
        "id", "n", "most", "stretch", "at",
        F.substring(F.col("v"), F.col("at") + 1, F.col("stretch") + (q - 1)).alias("part"))
    last = F.least(F.length("part") - q, F.col("stretch") - 1)
    grams = cut.where(last >= 0).select("*", F.explode(F.sequence(F.lit(0), last)).alias("i")).select(
        "id", "n", "most", F.xxhash64(F.substring(F.col("part"), F.col("i") + 1, F.lit(q))).alias("g"),
        (F.col("at") + F.col("i")).alias("p"))
    # Any order of the grams is exact; counting occurrences puts the rare ones first. Those that
    # occur once come before all others, so they need no rows to be ranked.
    often = grams.groupBy("g").agg(F.count("*").alias("often")).where("often > 1")
    own = Window.partitionBy("id")
    once = F.col("n") - (q - 1) - F.count("*").over(own)
    ranked = grams.join(often.hint("merge"), "g").withColumn(
        "rank", once + F.row_number().over(own.orderBy("often", "g", "p")))
    return ranked.where(F.col("rank") <= F.col("most")).select("id", "n", "g", "p", "rank")


def _maybe_long(values: DataFrame, threshold: float) -> DataFrame:
    """Strings that may have a partner, or be one, of more than ``LONG`` characters."""
    return values.where(_longest_partner(F.length("v"), threshold) > LONG)


def _by_grams(values: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs whose longer string has more than ``LONG`` characters and allows three edits or more."""
    if threshold < LEAST_FOR_GRAMS:
        return values.select(F.col("v").alias("a"), F.col("v").alias("b"), F.lit(False).alias("possible")).limit(0)
    q, grams = _gram_length(threshold), rare_grams(values, threshold)
    edits = _allowed(F.col("n"), threshold)
    longer = grams.where((F.col("n") > LONG) & (edits > MAX_DELETIONS) & (F.col("rank") <= edits * q + 1)).select(
        F.col("id").alias("y"), F.col("n").alias("m"), "g", F.col("p").alias("o"), edits.alias("d"))
    n, m, d = F.col("n"), F.col("m"), F.col("d")
    found = grams.hint("merge").join(longer, "g").where(
        ((n < m) | ((n == m) & (F.col("id") < F.col("y")))) & (m - n <= d) & (F.abs(F.col("p") - F.col("o")) <= d))
    pairs = found.select(F.col("id").alias("x"), "y").distinct()
    texts = _maybe_long(values, threshold).select(F.unhex(F.md5("v")).alias("id"), "v")
    joined = (pairs.join(texts.select(F.col("id").alias("x"), F.col("v").alias("a")).hint("merge"), "x")
              .join(texts.select(F.col("id").alias("y"), F.col("v").alias("b")).hint("merge"), "y"))
    # A distance of long texts costs far more than their bytes tell: tasks must not be coalesced by size.
    return joined.repartition(_tasks(values), "x", "y").select("a", "b", F.lit(True).alias("possible"))


def _by_pieces(values: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs whose longer string allows three edits or more, and is not looked up by grams.

    The shorter string is cut into ``g = d // 2 + 1`` pieces, so that one of them
    carries at most one edit: after a deletion on both sides it meets a stretch of
    the longer string. Taking the first such piece ``i``, every piece before it
    has two edits or more, which leaves ``d - 2 i`` for the rest and bounds where
    the stretch may start.
    """
    size = F.length("v")

    # The shorter side: its pieces, for every cut a longer partner may ask for.
    most = F.lit(LONG if threshold >= LEAST_FOR_GRAMS else 1 << 30)
    partners = F.filter(
        F.sequence(size, F.greatest(F.least(_longest_partner(size, threshold), most), size)),
        lambda n: (_allowed(n, threshold) > MAX_DELETIONS) & (n <= most))
    cuts = F.array_distinct(F.transform(partners, lambda n: _pieces(_allowed(n, threshold))))
    short = values.select("v", F.explode(cuts).alias("g"))
    short = short.select("v", "g", size.alias("shorter"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).alias("i"))
    start = _piece_start(F.col("shorter"), F.col("g"), F.col("i"))
    end = _piece_start(F.col("shorter"), F.col("g"), F.col("i") + 1)
    left = _piece_keys(short, start, end - start, None).withColumnsRenamed(
        {"v": "a", "gone": "gone_a"})

    # The longer side: the stretches where such a piece may be found.
    long = values.where(size <= most).select("v", _allowed(size, threshold).alias("d")).where(
        F.col("d") > MAX_DELETIONS).withColumn("g", _pieces(F.col("d")))
    long = long.select("*", F.explode(F.sequence(
        F.greatest(size - F.col("d"), F.lit(1)), size)).alias("shorter"))
    long = long.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).alias("i"))
    long = long.select("*", F.explode(F.array(*[F.lit(x) for x in (-1, 0, 1)])).alias("grown"))
    start = _piece_start(F.col("shorter"), F.col("g"), F.col("i"))
    end = _piece_start(F.col("shorter"), F.col("g"), F.col("i") + 1)
    # Total growth is shift before the piece, growth in it, and growth after it.
    spare = F.col("d") - 2 * F.col("i") - F.abs("grown")
    centre = size - F.col("shorter") - F.col("grown")
    first = F.when(F.col("i") == 0, F.lit(0)).otherwise(
        F.greatest(centre - spare, -F.col("d"), -start))
    last = F.when(F.col("i") == 0, F.lit(0)).otherwise(F.least(centre + spare, F.col("d")))
    width = end - start + F.col("grown")
    long = long.withColumns({"first": first, "last": last, "start": start, "width": width}).where(
        (F.col("first") <= F.col("last")) & (F.col("width") >= 0))
    long = long.select("*", F.explode(F.sequence("first", "last")).alias("shift"))
    right = _piece_keys(long, F.col("start") + F.col("shift"), F.col("width"),
                        F.col("grown")).withColumnsRenamed({"v": "b", "gone": "gone_b"})
    shorter, longer = F.length("a"), F.length("b")
    possible = (
        ((shorter < longer) | ((shorter == longer) & (F.col("a") < F.col("b"))))
        & (longer - shorter <= _allowed(longer, threshold))
        & F.coalesce(F.col("gone_a") != F.col("gone_b"), F.lit(True)))
    return _meet(left, right).select("a", "b", possible.alias("possible"))


def _tasks(values: DataFrame) -> int:
    return int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def similar_pairs(values: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs ``a, b, similarity`` of the strings in column ``v``."""
    if not 0 < threshold <= 1:
        raise ValueError("fuzzy_threshold must be in (0, 1]")
    # Few bytes of strings become many keys: keep the tasks the session asks for.
    values = values.repartition(_tasks(values), F.xxhash64("v"))
    candidates = _by_deletion(values, threshold).unionByName(
        _by_pieces(values, threshold)).unionByName(_by_grams(values, threshold))
    # The cheap test guards the distance, which with its bound stops early (-1).
    longer = F.greatest(F.length("a"), F.length("b"), F.lit(1))
    distance = F.call_function("levenshtein", F.col("a"), F.col("b"), _allowed(longer, threshold))
    ordered = candidates.where("possible").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # Filters on a plain column would each compute the distance again; on a generated one they don't.
    near = ordered.select("a", "b", F.explode(F.array(distance)).alias("edits")).where("edits >= 0")
    scored = near.distinct().withColumn("similarity", F.lit(1.0) - F.col("edits") / longer)
    return scored.where(F.col("similarity") >= F.lit(threshold)).select("a", "b", "similarity")


def fuzzy(check: Check, df: DataFrame) -> TablePlan:
    text = F.col(check.column).cast("string")
    if check.param("fuzzy_algorithm", "levenshtein") == "soundex":
        return _soundex(check, df, text)
    threshold = float(check.param("fuzzy_threshold", 0.85))
    counted = df.groupBy(text.alias("v")).agg(F.count("*").alias("n"))
    values = counted.where(F.col("v").isNotNull())
    pairs = similar_pairs(values.select("v"), threshold)
    both_ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    partners = pairs.select(F.inline(both_ways))
    weights = values.select(F.col("v").alias("b"), F.col("n").alias("m"))
    # Rows of all partner values, per value: each distinct pair counts n * m row pairs.
    linked = partners.join(weights, "b").groupBy(F.col("a").alias("v")).agg(
        F.sum("m").alias("near"))
    judged = counted.join(linked, "v", "left").withColumn(
        "near", F.coalesce("near", F.lit(0)))
    n, near = F.col("n"), F.col("near")
    hit = F.col("v").isNotNull() & ((n > 1) | (near > 0))
    counts = judged.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        sum_where(hit, n).alias("failed_rows"),
        # Every cross pair is seen from both ends, hence the halves.
        F.floor(sum_where(F.col("v").isNotNull(), n * (n - 1) + n * near) / 2)
        .cast("long").alias("duplicate_pairs"),
    )

    def violations() -> DataFrame:
        rows = df.withColumn("__k0", text)
        return match_keys(rows, judged.where(hit).select(F.col("v").alias("__k0")),
                          "left_semi", ["__k0"]).drop("__k0")

    return TablePlan(_finish(counts), violations, ("duplicate_pairs",))


def _soundex(check: Check, df: DataFrame, text: Column) -> TablePlan:
    """Equal codes: the pairs of a group of n follow from n, none is formed."""
    rows = df.withColumn("__k0", F.soundex(text))
    groups = rows.groupBy("__k0").agg(F.count("*").alias("n"))
    n = F.col("n")
    many = F.col("__k0").isNotNull() & (n > 1)
    counts = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        sum_where(many, n).alias("failed_rows"),
        F.floor(sum_where(many, n * (n - 1)) / 2).cast("long").alias("duplicate_pairs"),
    )

    def violations() -> DataFrame:
        return match_keys(rows, groups.where(many), "left_semi", ["__k0"]).drop("__k0")

    return TablePlan(_finish(counts), violations, ("duplicate_pairs",))


def _finish(counts: DataFrame) -> DataFrame:
    return counts.withColumns({
        "passed_rows": F.col("total_rows") - F.col("failed_rows"),
        "skipped_rows": F.lit(0).cast("long"),
        "evaluated_rows": F.col("total_rows"),
    })
